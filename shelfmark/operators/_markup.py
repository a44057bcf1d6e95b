"""Per-page helper of the hit extraction job: tag soup to flat lists, and CSS matching.

Runs inside Spark's Python workers only.  A page becomes parallel lists in
document order (an element's descendants are one index range), so "inside this
element" and "next element after" are integer comparisons.  The tolerance rules
cover what captured pages contain: void elements, unclosed ``p/li/td/tr/option``,
stray end tags and raw ``script``/``style`` text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

# Unquoted "<" ends the attempt, so broken markup costs one look per tag, not one per pair of tags.
_INSIDE_TAG = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    r"<(?:!--(.*?)(?:-->|\Z)"  # 1 comment
    rf"|(script|style)((?=[\s/>]){_INSIDE_TAG})>(.*?)(?:</\2\b[^>]*>|\Z)"  # 2 raw element, 3 attributes, 4 text
    rf"|(/?)([a-z][^\s/>]*)(?:({_INSIDE_TAG})>|([^>]*)>)"  # 5 end mark, 6 name, 7 or 8 (open quote) attributes
    r"|[!?/][^>]*>)",
    re.S | re.I,
)
# The same tokens, each as one group (and a raw element's name as another), to split a page into texts and tokens.
_SPLIT = re.compile(
    r"(<(?:!--.*?(?:-->|\Z)"
    rf"|(script|style)(?=[\s/>]){_INSIDE_TAG}>.*?(?:</\2\b[^>]*>|\Z)"
    rf"|/?[a-z][^\s/>]*(?:{_INSIDE_TAG}>|[^>]*>)"
    r"|[!?/][^>]*>))",
    re.S | re.I,
)
# What may stand between "<" and the next ">" so that the two are a tag, whatever comes after (a raw element's start is not).
_PLAIN = re.compile(rf"(?!script|style|!--)(?:/?[a-z][^\s/>]*+{_INSIDE_TAG}|[!?][^>]*)", re.S | re.I)
# Such a tag that starts an element and has attributes between apostrophes only, cut at these: its name and first attribute, the others, its end.
_NAMED = re.compile(r"([a-z][a-z0-9]*)\s+([a-z][a-z0-9_:-]*)=", re.I | re.A)
_MORE = re.compile(r"\s+([a-z][a-z0-9_:-]*)=", re.I | re.A)
_LAST = re.compile(r"\s*/?")
_BLANK = " \t\r\n\f"
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Text below these elements is not page text; only the element itself shows it.
_QUIET = frozenset("script style template rt rp".split())
# A start tag of the first kind ends an open element of the second kind on top of the stack.
_CELL = frozenset("td th p span b i u a font".split())
_ENDS = {
    "li": frozenset(["li", "p"]),
    "option": frozenset(["option"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "td": _CELL,
    "th": _CELL,
    "tr": _CELL | {"tr", "caption"},
    "a": frozenset(["a"]),
    **dict.fromkeys(("tbody", "thead", "tfoot"), _CELL | {"tr", "caption", "tbody", "thead", "tfoot"}),
    **dict.fromkeys("p div ul ol dl table form section article h1 h2 h3 h4 h5 h6".split(), frozenset(["p"])),
}
# An end tag does not reach through an open element of higher weight.
_WEIGHT = {"div": 1, "td": 2, "th": 2, "tr": 3, "tbody": 4, "thead": 4, "tfoot": 4, "table": 5, "body": 6, "html": 7}


# What a token is.
_IGNORED, _COMMENT, _RAW, _OPEN, _CLOSE = range(5)


class Layouts:
    """What pages of one reading have in common, so that it is worked out once.

    Pages come out of templates: most tags recur, and so do whole sequences of tags.  A page's layout is its sequence of
    tags, with what selectors find out about their attributes' values, and which texts between them are there.  Elements,
    their places and what selectors find depend on that alone; texts and other attribute values are each page's
    own.  A layout met again is looked up, any other is read as it comes.  What is held is bounded (``TOKENS``,
    ``LAYOUT_TOKENS``): beyond, everything is forgotten and learned anew.

    ``tested`` are the tests (attribute, operator, value) that selectors put to attributes other than id and class
    (None: any value counts), ``blanks`` says that they tell blank texts from others.
    """

    TOKENS = 20_000  # different tags held, and tags of all layouts held, times five
    LAYOUT_TOKENS = 2_000  # tags of a layout that is held
    TOKEN_LENGTH = 300  # characters of a tag that is held

    def __init__(self, wanted: frozenset[str], tested: frozenset[tuple[str, str, str]] | None = None, blanks: bool = True):
        self.wanted, self.blanks = wanted, blanks
        self.tested = None if tested is None else {name: sorted(test[1:] for test in tested if test[0] == name) for name, _, _ in tested}
        self._forget()

    def _forget(self) -> None:
        self.tokens, self.tags, self.forms, self.numbers, self.shapes, self.size = {}, {}, {}, {}, {}, 0

    def _told(self, key: str, value: str) -> str | tuple[bool, ...]:
        """What selectors can find out about an attribute's value."""
        if self.tested is None or key in ("id", "class"):
            return value
        return tuple([_OPERATORS[operator](value, want) for operator, want in self.tested.get(key, ())])

    def _token(self, token: str) -> tuple:
        """(number of what counts for the layout, kind, name, attributes, text) of a token."""
        comment, raw, raw_rest, raw_text, close, name, rest, broken = _TOKEN.match(token).groups()
        attrs, text = {}, None
        if name is None and raw is None:
            kind, text = (_IGNORED, None) if comment is None else (_COMMENT, comment)
            layout = kind
        else:
            name = (name or raw).lower()
            kind = _CLOSE if close else _RAW if raw else _OPEN
            layout = (kind, name)
        if kind in (_RAW, _OPEN):
            if rest := rest or raw_rest or broken:
                for key, quoted, single, bare in _ATTR.findall(rest):
                    value = quoted or single or bare
                    attrs.setdefault(key.lower(), unescape(value) if "&" in value else value)
                layout += tuple((key, self._told(key, value)) for key, value in attrs.items())
            if raw:
                text = raw_text
                layout += (not raw_text, not raw_text.strip(_BLANK))
        entry = (self.numbers.setdefault(layout, len(self.numbers)), kind, name, attrs, text)
        if len(token) <= self.TOKEN_LENGTH:
            self.tokens[token] = entry
        return entry

    def _tag(self, tag: str) -> tuple | None:
        """The entry of ``<tag>``, None if it is no plain tag."""
        parts = tag.split("'")
        names = self._form(tuple(parts[::2])) if len(parts) > 2 else None
        if names is not None:
            name, *keys = names
            attrs = dict(zip(keys, [unescape(value) if "&" in value else value for value in parts[1::2]], strict=True))
            layout = (_OPEN, name, *[(key, self._told(key, value)) for key, value in attrs.items()])
            entry = (self.numbers.setdefault(layout, len(self.numbers)), _OPEN, name, attrs, None)
        elif _PLAIN.fullmatch(tag):
            entry = self._token(f"<{tag}>")
        else:
            return None
        if len(tag) <= self.TOKEN_LENGTH:
            self.tags[tag] = entry
        return entry

    def _form(self, form: tuple[str, ...]) -> tuple[str, ...] | None:
        """Name of the element and of each attribute of a start tag, from what stands around its values."""
        if form in self.forms:
            return self.forms[form]
        first, *more, last = form
        found = [_NAMED.fullmatch(first), *[_MORE.fullmatch(part) for part in more]]
        names = None
        if all(found) and _LAST.fullmatch(last):
            names = tuple(group.lower() for match in found for group in match.groups())
            if names[0] in ("script", "style") or len(set(names[1:])) < len(names) - 1:
                names = None
        if sum(map(len, form)) <= self.TOKEN_LENGTH:
            self.forms[form] = names
        return names

    def _cut(self, html: str) -> tuple[list[str], list[tuple]]:
        """The texts between a page's tokens, and what the tokens are."""
        first, *cells = html.split("<")
        pairs = [cell.split(">", 1) for cell in cells]
        if all([len(pair) == 2 for pair in pairs]):
            known, entries = self.tags, []
            for tag, _ in pairs:
                entry = known.get(tag) or self._tag(tag)
                if entry is None:
                    break
                entries.append(entry)
            else:
                return [first, *[text for _, text in pairs]], entries
        # The added ">" completes a tag cut off at the end; it never becomes text.
        parts = _SPLIT.split(html + ">")
        texts, known = parts[::3], self.tokens
        if texts[-1]:
            texts[-1] = texts[-1][:-1]
        return texts, [known.get(token) or self._token(token) for token in parts[1::3]]

    def read(self, html: str) -> tuple[_Shape, list[str], list[tuple]]:
        """A page's layout, the texts between its tokens, and what the tokens are."""
        if max(len(self.numbers), self.size // 5) > self.TOKENS:
            self._forget()
        elif len(self.tokens) + len(self.tags) + len(self.forms) > self.TOKENS:
            # Tags with values of their own fill these; what the tags of layouts are stays known.
            self.tokens, self.tags, self.forms = {}, {}, {}
        texts, entries = self._cut(html)
        if len(entries) > self.LAYOUT_TOKENS:
            return _Shape(entries, texts, self.wanted), texts, entries
        if self.blanks:
            # A text with a reference may be blank once it is resolved, so it counts as it is.
            filled = [text and (text if "&" in text else 2 if text.strip(_BLANK) else 1) for text in texts]
        else:
            filled = map(bool, texts)
        key = (*[entry[0] for entry in entries], None, *filled)
        shape = self.shapes.get(key)
        if shape is None:
            shape = self.shapes[key] = _Shape(entries, texts, self.wanted, held=True)
            self.size += len(entries)
        return shape, texts, entries


class _Shape:
    """The elements of a layout in parallel lists; element 0 is the page itself."""

    __slots__ = (
        "tag", "parent", "nth", "end", "first_text", "last_text", "owner", "kind", "index", "at", "sources",
        "depths", "barriers", "seen", "pieces", "plans", "plain",
    )

    def __init__(self, entries: list[tuple], texts: list[str], wanted: frozenset[str], held: bool = False):
        self.tag, self.parent, self.nth = [""], [-1], [1]
        self.end, self.first_text, self.last_text = [0], [0], [0]
        self.owner, self.kind = [], []
        # The token that opened an element, and the places in the page that a text comes from.
        self.at, self.sources = [-1], []
        self.index = {key: [] for key in wanted}
        # Depths of the open elements by name, and by weight: an end tag is settled without a climb.
        self.depths, self.barriers = {}, [[] for _ in range(max(_WEIGHT.values()) + 1)]
        # What selectors have found so far; the texts of elements, and what rules look at, if the layout may be met again.
        self.seen, self.pieces, self.plans = {}, {} if held else None, {} if held else None
        self._read(entries, texts)
        # Texts that each come from one place between two tokens.
        self.plain = self.sources if all(isinstance(place, int) and place >= 0 for place in self.sources) else None

    def _read(self, entries: list[tuple], texts: list[str]) -> None:
        stack, children, quiet, pending = [0], [0], [], []
        tags, end, last_text, sources = self.tag, self.end, self.last_text, self.sources
        for number, (_, kind, name, attrs, text) in enumerate(entries):
            if texts[number]:
                pending.append(number)
            if kind == _IGNORED:
                continue
            if kind == _CLOSE:
                # Nearly every end tag ends the element on top.
                depth = len(stack) - 1 if tags[stack[-1]] == name else self._opened(name)
                if depth:
                    if pending:
                        self._flush(pending, stack[-1], quiet)
                    self._close(stack, children, quiet, depth)
                continue
            if pending:
                self._flush(pending, stack[-1], quiet)
            if kind == _COMMENT:
                self._text(~number, stack[-1], "#")
                continue
            if (ends := _ENDS.get(name)) is not None:
                while tags[stack[-1]] in ends:
                    self._close(stack, children, quiet, len(stack) - 1)
            children[-1] += 1
            here = self._open(name, attrs, number, stack[-1], children[-1])
            if kind == _RAW:
                if text:
                    self._text(~number, here, name)
            elif name not in _VOID:
                self.depths.setdefault(name, []).append(len(stack))
                if weight := _WEIGHT.get(name):
                    self.barriers[weight].append(len(stack))
                stack.append(here)
                children.append(0)
                if name in _QUIET:
                    quiet.append(here)
                continue
            end[here], last_text[here] = len(tags), len(sources)
        if texts[-1]:
            pending.append(len(texts) - 1)
        if pending:
            self._flush(pending, stack[-1], quiet)
        self._close(stack, children, quiet, 0)

    def _open(self, name: str, attrs: dict[str, str], number: int, parent: int, nth: int) -> int:
        here, index = len(self.tag), self.index
        for key, value in attrs.items():
            if key == "id":
                if (key := "#" + value) in index:
                    index[key].append(here)
            elif key == "class":
                for part in value.split():
                    # A class named twice is one class.
                    if (key := "." + part) in index and index[key][-1:] != [here]:
                        index[key].append(here)
            elif (key := "[" + key) in index:
                index[key].append(here)
        if name in index:
            index[name].append(here)
        if "*" in index:
            index["*"].append(here)
        self.tag.append(name)
        self.at.append(number)
        self.parent.append(parent)
        self.nth.append(nth)
        self.end.append(0)
        self.first_text.append(len(self.sources))
        self.last_text.append(0)
        return here

    def _opened(self, name: str) -> int:
        """Depth of the open element that an end tag closes; 0 if there is none or a heavier one is in the way."""
        depths = self.depths.get(name)
        if not depths:
            return 0
        for heavier in self.barriers[_WEIGHT.get(name, 0) + 1 :]:
            if heavier and heavier[-1] > depths[-1]:
                return 0
        return depths[-1]

    def _close(self, stack, children, quiet, depth) -> None:
        elements, texts = len(self.tag), len(self.sources)
        while len(stack) > depth:
            here = stack.pop()
            children.pop()
            if here:
                name = self.tag[here]
                self.depths[name].pop()
                if weight := _WEIGHT.get(name):
                    self.barriers[weight].pop()
            self.end[here], self.last_text[here] = elements, texts
            if quiet and quiet[-1] == here:
                quiet.pop()

    def _flush(self, pending, owner, quiet) -> None:
        place = pending[0] if len(pending) == 1 else tuple(pending)
        pending.clear()
        self._text(place, owner, self.tag[quiet[-1]] if quiet else "")

    def _text(self, place: int | tuple[int, ...], owner: int, kind: str) -> None:
        self.sources.append(place)
        self.owner.append(owner)
        self.kind.append(kind)


class Document:
    """One page: its layout, texts and attributes; element 0 is the page itself."""

    __slots__ = (
        "tag", "parent", "nth", "end", "first_text", "last_text", "texts", "owner", "kind", "index",
        "seen", "solid", "shape", "entries", "_attrs", "_small",
    )

    def __init__(self, html: str, wanted: frozenset[str] | Layouts):
        shape, texts, self.entries = (wanted if isinstance(wanted, Layouts) else Layouts(wanted)).read(html)
        self.shape, self._attrs, self.seen = shape, None, shape.seen
        self.tag, self.parent, self.nth, self.end = shape.tag, shape.parent, shape.nth, shape.end
        self.first_text, self.last_text, self.index = shape.first_text, shape.last_text, shape.index
        self.owner, self.kind = shape.owner, shape.kind
        self._small = None  # its texts in small letters (made when first asked for)
        self.solid = None  # the texts that are not blank (made when first asked for)
        if shape.plain is not None:
            self.texts = [unescape(text) if "&" in (text := texts[place]) else text for place in shape.plain]
        else:
            self.texts = [self._from(place, texts) for place in shape.sources]

    def _from(self, place: int | tuple[int, ...], texts: list[str]) -> str:
        if isinstance(place, int):
            if place < 0:
                return self.entries[~place][4]
            text = texts[place]
        else:
            text = "".join([texts[one] for one in place])
        return unescape(text) if "&" in text else text

    @property
    def attrs(self) -> list[dict[str, str]]:
        if self._attrs is None:
            self._attrs = [{}, *[self.entries[number][3] for number in self.shape.at[1:]]]
        return self._attrs

    def is_quiet(self, element: int) -> bool:
        """Whether the element's text is not part of the text around it."""
        return self.tag[element] in _QUIET

    def lacks(self, words: list[str]) -> bool:
        """Whether it is sure that no text of the page holds any of ``words``, in small or other letters."""
        if self._small is None:
            together = "\0".join(self.texts)
            # Other scripts have letters that count as equal to Latin ones.
            self._small = together.lower() if together.isascii() else False
        small = self._small
        return small is not False and not any([word in small for word in words])

    def places(self, element: int) -> list[int]:
        """Which of the page's texts are an element's text."""
        held = self.shape.pieces
        if held is None or (places := held.get(element)) is None:
            own = self.tag[element] if self.tag[element] in _QUIET else ""
            places = [i for i in range(self.first_text[element], self.last_text[element]) if self.kind[i] == own]
            if held is not None and len(places) <= 64:
                held[element] = places
        return places

    def text(self, element: int, form: str) -> str:
        """``tight`` strips each text and joins without a gap, ``spaced`` with a space, ``raw`` as is."""
        pieces = [self.texts[i] for i in self.places(element)]
        if form == "raw":
            return "".join(pieces)
        pieces = [piece for piece in map(str.strip, pieces) if piece]
        return (" " if form == "spaced" else "").join(pieces)

    def head(self, element: int, form: str, size: int = 64) -> str:
        """How the element's text begins: all of it, or at least ``size`` characters."""
        if form == "raw" or self.tag[element] in _QUIET:
            return self.text(element, form)
        if self.solid is None:
            self.solid = [i for i, text in enumerate(self.texts) if not self.kind[i] and not text.isspace()]
        pieces, length, at = [], 0, bisect_left(self.solid, self.first_text[element])
        while at < len(self.solid) and self.solid[at] < self.last_text[element] and length < size:
            pieces.append(self.texts[self.solid[at]].strip())
            length += len(pieces[-1])
            at += 1
        return (" " if form == "spaced" else "").join(filter(None, pieces))

    def next_element(self, element: int, keys: tuple[str, ...]) -> int | None:
        """First element of the given tags that starts after ``element`` starts."""
        after = []
        for key in keys:
            found = self.index[key]
            at = bisect_left(found, element + 1)
            after.extend(found[at : at + 1])
        return min(after, default=None)


_PART = re.compile(
    r"(?P<tag>^(?:[a-zA-Z][\w-]*|\*))"
    r"|\#(?P<id>[\w-]+)"
    r"|\.(?P<cls>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)[\"']?(?P<value>[^\"'\]]*)[\"']?)?\]"
    r"|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*)\))?"
)
_OPERATORS = {
    None: lambda have, want: True,
    "=": str.__eq__,
    "*=": str.__contains__,
    "^=": str.startswith,
    "$=": str.endswith,
}


def _test(part: re.Match):
    """A predicate ``(document, element) -> bool`` for one simple selector."""
    if part["tag"] == "*":
        return lambda doc, i: True
    if name := part["tag"]:
        return lambda doc, i: doc.tag[i] == name
    if ident := part["id"]:
        return lambda doc, i: doc.attrs[i].get("id") == ident
    if cls := part["cls"]:
        return lambda doc, i: cls in doc.attrs[i].get("class", "").split()
    if attr := part["attr"]:
        check, value = _OPERATORS[part["op"]], part["value"]
        return lambda doc, i: attr in doc.attrs[i] and check(doc.attrs[i][attr], value)
    pseudo, arg = part["pseudo"], part["arg"]
    if pseudo == "not":
        inner = Selector(arg)
        return lambda doc, i: not inner.matches(doc, i)
    if pseudo == "empty":
        return lambda doc, i: doc.end[i] == i + 1 and not any(
            doc.texts[t].strip(_BLANK)
            for t in range(doc.first_text[i], doc.last_text[i])
            if doc.kind[t] != "#"
        )
    if pseudo in ("first-child", "nth-child"):
        n = int(arg or 1)
        return lambda doc, i: doc.nth[i] == n
    raise ValueError(f"unsupported selector part :{pseudo}")


class Selector:
    """A comma list of descendant chains over tag, #id, .class, [attr], :not, :empty, :nth-child."""

    def __init__(self, text: str):
        # Per chain: index key of its last compound, tests left after that lookup, compounds above.
        self.chains = []
        self.whole = []
        self._tested, self._blanks = set(), ":empty" in text
        for chain in re.split(r",(?![^(\[]*[)\]])", text):
            compounds = []
            for compound in re.findall(r"(?:\[[^\]]*\]|\([^)]*\)|[^\s\[(])+", chain.strip()):
                parts = list(_PART.finditer(compound))
                if "".join(part[0] for part in parts) != compound:
                    raise ValueError(f"unsupported selector {text!r}")
                compounds.append(parts)
            if not compounds:
                raise ValueError(f"empty selector in {text!r}")
            for part in (part for parts in compounds for part in parts):
                if part["op"]:
                    self._tested.add((part["attr"], part["op"], part["value"]))
                elif part["pseudo"] == "not":
                    self._tested |= Selector(part["arg"]).tested()
            above = [[_test(part) for part in parts] for parts in reversed(compounds[:-1])]
            key, settled = self._key(compounds[-1])
            left = [_test(part) for part in compounds[-1] if part is not settled]
            self.chains.append((key, left, above))
            self.whole.append(([_test(part) for part in compounds[-1]], above))

    @staticmethod
    def _key(parts: list[re.Match]) -> tuple[str, re.Match | None]:
        """The narrowest index to look a compound up in, and the part that lookup settles."""
        for group, form in (("id", "#{}"), ("cls", ".{}"), ("attr", "[{}"), ("tag", "{}")):
            for part in parts:
                # The presence index holds attributes other than id and class, which have their own.
                if part[group] and not (group == "attr" and part["attr"] in ("id", "class")):
                    return form.format(part[group]), None if part["op"] else part
        return "*", None

    def keys(self) -> set[str]:
        return {key for key, _, _ in self.chains}

    def tested(self) -> set[tuple[str, str, str]]:
        """Tests of attributes' values: attribute, operator, value."""
        return self._tested

    def tells_blanks(self) -> bool:
        return self._blanks

    def _fits(self, doc: Document, element: int, tests, above, number: int) -> bool:
        for test in tests:
            if not test(doc, element):
                return False
        return not above or self._below(doc, doc.parent[element], above, doc.seen.setdefault((id(self), -1 - number), {}))

    @staticmethod
    def _below(doc: Document, at: int, above, known: dict[int, bool]) -> bool:
        """Whether ``at`` and the elements around it hold the compounds ``above``, nearest first.

        The answer is noted for every element on the way, so a page's elements are climbed once.
        """
        level, way = 0, []
        while at > 0 and level < len(above):
            here = at * len(above) + level
            if (answer := known.get(here)) is not None:
                break
            way.append(here)
            if all(test(doc, at) for test in above[level]):
                level += 1
            at = doc.parent[at]
        else:
            answer = level == len(above)
        known.update(dict.fromkeys(way, answer))
        return answer

    def matches(self, doc: Document, element: int) -> bool:
        return any(self._fits(doc, element, tests, above, number) for number, (tests, above) in enumerate(self.whole))

    def _next(self, doc: Document, number: int, low: int, high: int) -> int | None:
        """A chain's first match from ``low`` to ``high``.  Its candidates are tested in page order, each once."""
        key, tests, above = self.chains[number]
        state = doc.seen.get((id(self), number))
        if state is None:
            state = doc.seen[id(self), number] = [[], 0]
        found, candidates = state[0], doc.index[key]
        at = bisect_left(found, low)
        if at < len(found):
            return found[at] if found[at] < high else None
        while state[1] < len(candidates) and (element := candidates[state[1]]) < high:
            state[1] += 1
            if self._fits(doc, element, tests, above, number):
                found.append(element)
                if element >= low:
                    return element
        return None

    def all(self, doc: Document, scope: int) -> list[int]:
        out = set()
        high = doc.end[scope] if scope else len(doc.tag)
        for number, (key, _, _) in enumerate(self.chains):
            if doc.index[key]:
                low = scope + 1
                while (element := self._next(doc, number, low, high)) is not None:
                    out.add(element)
                    low = element + 1
        return sorted(out)

    def first(self, doc: Document, scope: int) -> int | None:
        best = None
        high = doc.end[scope] if scope else len(doc.tag)
        for number, (key, _, _) in enumerate(self.chains):
            if doc.index[key]:
                element = self._next(doc, number, scope + 1, high if best is None else best)
                if element is not None:
                    best = element
        return best
