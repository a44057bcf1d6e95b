"""X1: parse every page once and report what the selector rules find.

The one step that leaves the JVM.  ``extract_hits`` is a map over partitions
(no shuffle): Arrow batches of pages go in, and one array column per rule field
comes out.  The page text itself is dropped at the boundary, so everything after
this job works on small rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.operators._markup import Document, Layouts, Selector
from shelfmark.rules import HOLDS, Rule

HIT = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("clean", T.StringType()),
    ]
)
NODE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("parent_tight", T.StringType()),
        T.StructField("parent_spaced", T.StringType()),
        T.StructField("next_tight", T.StringType()),
        T.StructField("next_spaced", T.StringType()),
    ]
)
# Pages turned into one outgoing Arrow batch; keeps worker memory flat for large pages.
PAGES_PER_BATCH = 256


def _fields(rules: Sequence[Rule], scope: str = "") -> dict[str, list[Rule]]:
    """Rules of one scope, grouped by field in first-mention order, each sorted by rank."""
    fields: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.scope == scope:
            fields.setdefault(rule.field, []).append(rule)
    return {name: sorted(group, key=lambda r: r.rank) for name, group in fields.items()}


def hits_schema(rules: Sequence[Rule]) -> T.StructType:
    """The columns ``rules`` produce: an array per field, nested one level for scopes."""

    def element(name: str, group: list[Rule]) -> T.StructType:
        if group[0].mode == "nodes":
            return NODE
        inner = _fields(rules, name)
        extra = [T.StructField(child, T.ArrayType(element(child, rows))) for child, rows in inner.items()]
        return T.StructType([*HIT.fields, *extra])

    return T.StructType(
        [T.StructField(name, T.ArrayType(element(name, group))) for name, group in _fields(rules).items()]
    )


# A pattern that can only match where the text begins, and has no alternatives.
_ANCHORED = re.compile(r"(?:\(\?[a-z]+\))?\^[^|]*")
# A pattern of alternatives that each begin with letters, whatever their case: text without any of these words does not match.
_WORDED = re.compile(r"\(\?i\)(?:\^\\s\*)?((?:[a-z][^|()\[\]{}]*)(?:\|[a-z][^|()\[\]{}]*)*)")


def needed_words(pattern: str) -> list[str]:
    """Words in small letters of which a text must hold one if ``pattern`` is to match it; none if that cannot be told."""
    worded = _WORDED.fullmatch(pattern)
    if not worded:
        return []
    words = [re.match(r"[a-z :]+(?![*?+])|[a-z :]*(?=[a-z :][*?+])", part)[0] for part in worded[1].split("|")]
    return words if all(words) else []


# What the text of a step is: none, one text of the page, several joined, or what :meth:`_Rule.hit` says.
_NO_TEXT, _ONE, _JOINED, _AS_HIT = range(4)
# Elements and texts of a plan that is held for a layout.
_HELD = 64


class _Rule:
    """One rule, ready to run on documents."""

    def __init__(self, rule: Rule, number: int = 0):
        self.number, self.rank, self.form, self.clean = number, rule.rank, rule.form, rule.clean
        self.attrs = [attr for attr in rule.attrs.split(",") if attr]
        self.pattern = re.compile(rule.pattern) if rule.pattern else None
        self.holds = bool(rule.pattern) and rule.pattern.startswith(HOLDS)
        self.until = re.compile(rule.until) if rule.until else None
        anchored = rule.pattern and _ANCHORED.fullmatch(rule.pattern)
        self.beginning = regex.compile(rule.pattern) if anchored else None
        # Without flags that move "^", what matches at all matches where the text begins.
        first = anchored and "m" not in re.match(r"(?:\(\?([a-z]+)\))?", rule.pattern).expand(r"\1")
        self.finds = self.pattern and (self.pattern.match if first else self.pattern.search)
        self.words = needed_words(rule.pattern) if rule.pattern else []
        self.selector = None if rule.mode == "nodes" else Selector(rule.selector)

    def hit(self, doc: Document, element: int) -> dict | None:
        """What the rule reports of an element; None if its text lacks the pattern."""
        if self.beginning is not None and not self.beginning.match(doc.head(element, self.form), partial=True):
            return None
        text = None if self.form == "none" else doc.text(element, self.form)
        if self.pattern is not None and not self.pattern.search(text or ""):
            return None
        have = doc.attrs[element]
        attrs = {name: have[name] for name in self.attrs if name in have} if self.attrs else None
        return {"rank": self.rank, "ord": element, "text": text, "attrs": attrs, "clean": self.clean}

    def step(self, doc: Document, element: int) -> tuple:
        """How to tell what the rule reports of an element, on any page of the layout: (rule, element, kind, where, what joins them, token)."""
        token = doc.shape.at[element]
        if self.form == "none":
            return self, element, _NO_TEXT, None, "", token
        places = doc.places(element)
        if len(places) > (1 if self.beginning is not None else _HELD):
            return self, element, _AS_HIT, None, "", token
        if len(places) == 1 and self.form != "raw":
            return self, element, _ONE, places[0], "", token
        return self, element, _JOINED, places, {"raw": None, "spaced": " "}.get(self.form, ""), token


def _joined(texts: list[str], places: list[int], gap: str | None) -> str:
    if gap is None:
        return "".join([texts[at] for at in places])
    return gap.join([piece for at in places if (piece := texts[at].strip())])


def _program(fields: Sequence[_Field], doc: Document, scope: int) -> list[tuple]:
    """The fields that may find something, with their plans (None: text nodes)."""
    every = [(field, None if field.mode == "nodes" else field._planned(doc, scope)) for field in fields]
    return [(field, plan) for field, plan in every if plan is None or plan or field.mode == "first_or_page"]


class _Field:
    """One field's rules, by rank."""

    def __init__(self, name: str, group: list[Rule], rules: Sequence[Rule]):
        self.name, self.mode = name, group[0].mode
        if any(rule.mode != self.mode for rule in group):
            raise ValueError(f"the rules of field {name!r} have different modes")
        self.rules = [_Rule(rule, number) for number, rule in enumerate(group)]
        if self.mode == "nodes":
            if len(group) > 1:
                raise ValueError(f"field {name!r} finds text nodes and so has one rule")
            self.next_tags = tuple(tag for tag in re.split(r"[,\s]+", group[0].selector) if tag)
        self.children = [_Field(child, rows, rules) for child, rows in _fields(rules, name).items()]
        self.nothing = {child.name: [] for child in self.children}
        # Without an element in any of these there is nothing to find; most fields are absent from a page.
        self.needs = [] if self.mode in ("nodes", "first_or_page") else sorted(set().union(*(r.selector.keys() for r in self.rules)))

    def keys(self) -> set[str]:
        own = set(self.next_tags) if self.mode == "nodes" else set().union(*(r.selector.keys() for r in self.rules))
        return own.union(*(child.keys() for child in self.children))

    def selectors(self) -> list[Selector]:
        own = [] if self.mode == "nodes" else [rule.selector for rule in self.rules]
        return own + [selector for child in self.children for selector in child.selectors()]

    def _planned(self, doc: Document, scope: int) -> list[tuple]:
        """Which elements the rules look at: (rule, element), or (element, numbers of rules) if every element counts.

        That depends on a page's layout alone, so it is worked out once for a layout that may be met again.
        """
        plans, here = doc.shape.plans, (id(self), scope)
        if plans is not None and (plan := plans.get(here)) is not None:
            return plan
        if not any(doc.index[key] for key in self.needs) and self.needs:
            plan = []
        elif self.mode == "all":
            candidates: dict[int, list[int]] = {}
            for number, rule in enumerate(self.rules):
                for element in rule.selector.all(doc, scope):
                    candidates.setdefault(element, []).append(number)
            plan = sorted(candidates.items())
        else:
            found = ((rule, rule.selector.first(doc, scope)) for rule in self.rules)
            plan = [pair for pair in found if pair[1] is not None]
        if plans is not None and len(plan) <= 64:
            plans[here] = plan
        return plan

    def run(self, doc: Document, scope: int) -> list[dict]:
        if self.mode == "nodes":
            return self._nodes(doc, scope)
        return self._follow(doc, scope, self._planned(doc, scope))

    def _follow(self, doc: Document, scope: int, plan: list[tuple]) -> list[dict]:
        out = []
        if self.mode == "all":
            out = self._all(doc, plan) if plan else out
        else:
            for rule, element in plan:
                if hit := rule.hit(doc, element):
                    out.append(hit)
                    if self.mode == "first_or_page":
                        break
            if self.mode == "first_or_page" and not out:
                # The page stands in: it has no text of its own, and only text nodes are looked for in it.
                page = {"rank": None, "ord": scope, "text": None, "attrs": None, "clean": None}
                return [page | {c.name: c.run(doc, scope) if c.mode == "nodes" else [] for c in self.children}]
        if self.children:
            for hit in out:
                element = hit["ord"]
                hit |= self.nothing
                for child, plan in self._program(doc, element):
                    hit[child.name] = child._nodes(doc, element) if plan is None else child._follow(doc, element, plan)
        return out

    def _program(self, doc: Document, element: int) -> list[tuple]:
        """The children that may find something in an element, with their plans."""
        plans, here = doc.shape.plans, (id(self), ~element)
        if plans is not None and (program := plans.get(here)) is not None:
            return program
        program = _program(self.children, doc, element)
        if plans is not None:
            plans[here] = program
        return program

    def steps(self, doc: Document, plan: list[tuple] | None) -> list[tuple] | None:
        """A plan as steps, None if it is too long to be held (or looks for text nodes)."""
        if plan is None or len(plan) > _HELD:
            return None
        if self.mode == "all":
            return [(element, doc.is_quiet(element), [self.rules[number].step(doc, element) for number in numbers]) for element, numbers in plan]
        return [rule.step(doc, element) for rule, element in plan]

    def _all(self, doc: Document, plan: list[tuple[int, list[int]]]) -> list[dict]:
        """Every element's hit, in page order, up to the one that settles the field."""
        out = []
        barren = [0] * len(self.rules)  # up to this element the text around has been found to lack the pattern
        for element, numbers in plan:
            for number in numbers:
                rule = self.rules[number]
                if element < barren[number] and not doc.is_quiet(element):
                    continue
                if hit := rule.hit(doc, element):
                    out.append(hit)
                    if rule.until and rule.until.search(hit["text"] or ""):
                        return out
                    break
                if rule.holds and not doc.is_quiet(element):
                    barren[number] = max(barren[number], doc.end[element])
        return out

    def _nodes(self, doc: Document, scope: int) -> list[dict]:
        """Matching texts, up to the one that settles the field; of several in one element the first."""
        out, rule, told = [], self.rules[0], set()
        if rule.words and doc.lacks(rule.words):
            return out
        for at in range(doc.first_text[scope], doc.last_text[scope]):
            text, parent = doc.texts[at], doc.owner[at]
            if parent in told or not rule.pattern.search(text):
                continue
            told.add(parent)
            hit = {"ord": at, "text": text}
            after = doc.next_element(parent, self.next_tags)
            for name in rule.attrs:
                which, form = name.split("_")
                element = parent if which == "parent" else after
                hit[name] = None if element is None else doc.text(element, form)
            out.append(hit)
            if rule.until and any(hit[name] is not None and rule.until.match(f"{name}:{hit[name]}") for name in rule.attrs):
                break
        return out


def _column(rows: list[list[dict]], kind: pa.ListType) -> pa.Array:
    """The hits of a field, a list a page, as an Arrow array."""
    offsets = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    hits = list(chain.from_iterable(rows))
    parts = []
    for field in kind.value_type:
        name = field.name
        values = [hit.get(name) for hit in hits]
        if pa.types.is_list(field.type):
            parts.append(_column(values, field.type))
        else:
            parts.append(pa.array(values, field.type))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)


class _Found:
    """What one field found on a batch's pages, in columns.

    ``places`` are the pages (of a scoped field: the hits it lies in) that have hits, ``sizes`` how many.
    Pages whose layout is held are read by its steps, any other as :meth:`_Reader.read` does.
    """

    def __init__(self, field: _Field):
        self.field, self.children = field, [_Found(child) for child in field.children]
        self.by_name = {child.field.name: child for child in self.children}
        rules = field.rules
        # The page that stands in for an element is of no rule.
        self.ranks = pa.array([*(rule.rank for rule in rules), None], pa.int32())
        self.cleans = pa.array([*(rule.clean for rule in rules), None], pa.string())
        self.empty: dict[int, pa.Array] = {}
        self._begin()

    def _begin(self) -> None:
        self.places, self.sizes, self.numbers, self.ords, self.texts, self.nodes = [], [], [], [], [], []
        self.starts, self.names, self.values = [], [], []

    def put(self, hits: list[dict], place: int) -> None:
        """Hits as :meth:`_Field.run` gives them."""
        if not hits:
            return
        self.places.append(place)
        self.sizes.append(len(hits))
        if self.field.mode == "nodes":
            self.nodes += hits
            return
        rules = self.field.rules
        for hit in hits:
            # Rules of one rank differ in their clean-up at most, as far as a hit tells.
            number = next((rule.number for rule in rules if (rule.rank, rule.clean) == (hit["rank"], hit["clean"])), len(rules))
            here = len(self.ords)
            self._hit(number, hit["ord"], hit["text"], hit["attrs"])
            for child in self.children:
                child.put(hit[child.field.name], here)

    def _hit(self, number: int, element: int, text: str | None, attrs: dict[str, str] | None) -> None:
        self.numbers.append(number)
        self.ords.append(element)
        self.texts.append(text)
        self.starts.append(None if attrs is None else len(self.names))
        if attrs:
            self.names += attrs
            self.values += attrs.values()

    def read(self, doc: Document, scope: int, steps: list[tuple] | None, place: int) -> None:
        field = self.field
        if steps is None:
            self.put(field.run(doc, scope), place)
            return
        before = len(self.ords)
        if field.mode == "all":
            self._every(doc, steps)
        else:
            for step in steps:
                if self._take(doc, step) is not None and field.mode == "first_or_page":
                    break
            if field.mode == "first_or_page" and len(self.ords) == before:
                self.put(field._follow(doc, scope, []), place)
                return
        if size := len(self.ords) - before:
            self.places.append(place)
            self.sizes.append(size)
            if self.children:
                for here in range(before, before + size):
                    for child, inner in self._inner(doc, self.ords[here]):
                        child.read(doc, self.ords[here], inner, here)

    def _inner(self, doc: Document, element: int) -> list[tuple]:
        """The children that may find something in an element, with their steps."""
        plans, here = doc.shape.plans, (id(self), element)
        program = plans.get(here)
        if program is None:
            program = [(self.by_name[child.name], child.steps(doc, plan)) for child, plan in self.field._program(doc, element)]
            plans[here] = program
        return program

    def _take(self, doc: Document, step: tuple) -> str | None:
        """The text of a step's hit ("" if it reports none), which is added; None if there is no hit."""
        rule, element, kind, where, gap, token = step
        if kind == _ONE:
            text = doc.texts[where].strip()
        elif kind == _JOINED:
            text = _joined(doc.texts, where, gap)
        elif kind == _NO_TEXT:
            text = None
        else:
            hit = rule.hit(doc, element)
            if hit is None:
                return None
            self._hit(rule.number, element, hit["text"], hit["attrs"])
            return hit["text"] or ""
        if rule.finds is not None and not rule.finds(text or ""):
            return None
        self.numbers.append(rule.number)
        self.ords.append(element)
        self.texts.append(text)
        if rule.attrs:
            self.starts.append(len(self.names))
            have = doc.entries[token][3]
            for name in rule.attrs:
                if name in have:
                    self.names.append(name)
                    self.values.append(have[name])
        else:
            self.starts.append(None)
        return text or ""

    def _every(self, doc: Document, steps: list[tuple]) -> None:
        """As :meth:`_Field._all`."""
        barren: dict[int, int] = {}
        for element, quiet, tried in steps:
            for step in tried:
                rule = step[0]
                if barren and not quiet and element < barren.get(rule.number, 0):
                    continue
                text = self._take(doc, step)
                if text is not None:
                    if rule.until and rule.until.search(text):
                        return
                    break
                if rule.holds and not quiet:
                    barren[rule.number] = max(barren.get(rule.number, 0), doc.end[element])

    def column(self, kind: pa.ListType, count: int) -> pa.Array:
        """Hits of ``count`` places, forgotten then."""
        if not self.places:
            if count not in self.empty:
                if len(self.empty) > 8:
                    self.empty.clear()
                self.empty[count] = _column([[]] * count, kind)
            return self.empty[count]
        sizes = np.zeros(count + 1, np.int32)
        sizes[np.array(self.places) + 1] = self.sizes
        offsets = pa.array(np.cumsum(sizes, dtype=np.int32))
        if self.field.mode == "nodes":
            parts = [pa.array([hit.get(field.name) for hit in self.nodes], field.type) for field in kind.value_type]
        else:
            parts = [self._part(field) for field in kind.value_type]
        self._begin()
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(kind.value_type)), type=kind)

    def _part(self, field: pa.Field) -> pa.Array:
        if pa.types.is_list(field.type):
            return self.by_name[field.name].column(field.type, len(self.ords))
        if field.name == "ord":
            return pa.array(self.ords, field.type)
        if field.name == "text":
            return pa.array(self.texts, field.type)
        if field.name == "attrs":
            if not self.names and all(start is None for start in self.starts):
                return pa.nulls(len(self.ords), field.type)
            starts = pa.array([*self.starts, len(self.names)], pa.int32())
            return pa.MapArray.from_arrays(starts, pa.array(self.names, pa.string()), pa.array(self.values, pa.string()), type=field.type)
        table = self.ranks if field.name == "rank" else self.cleans
        return pa.nulls(len(self.ords), field.type) if table.null_count == len(table) else table.take(pa.array(self.numbers, pa.int32()))


class _Reader:
    """Rules of one kind of page, ready to run; :meth:`read` gives a list of hits a field."""

    def __init__(self, rules: Sequence[Rule]):
        self.fields = [_Field(name, group, rules) for name, group in _fields(rules).items()]
        self.place = {field.name: at for at, field in enumerate(self.fields)}
        selectors = [selector for field in self.fields for selector in field.selectors()]
        tested = frozenset().union(*(selector.tested() for selector in selectors))
        blanks = any(selector.tells_blanks() for selector in selectors)
        self.layouts = Layouts(frozenset().union(*(field.keys() for field in self.fields)), tested, blanks)
        self.found = [_Found(field) for field in self.fields]

    def read(self, page: str | None) -> list[list[dict]]:
        return self._hits(Document(page, self.layouts)) if page else [[] for _ in self.fields]

    def _hits(self, doc: Document) -> list[list[dict]]:
        plans = doc.shape.plans
        program = None if plans is None else plans.get("page")
        if program is None:
            program = [(self.place[field.name], field, plan) for field, plan in _program(self.fields, doc, 0)]
            if plans is not None:
                plans["page"] = program
        out: list[list[dict]] = [[] for _ in self.fields]
        for at, field, plan in program:
            out[at] = field._nodes(doc, 0) if plan is None else field._follow(doc, 0, plan)
        return out

    def add(self, page: str | None, row: int) -> None:
        """Reads page number ``row`` of a batch; :meth:`columns` gives what was found."""
        if not page:
            return
        doc = Document(page, self.layouts)
        plans = doc.shape.plans
        if plans is None:
            for found, hits in zip(self.found, self._hits(doc)):
                found.put(hits, row)
            return
        program = plans.get("steps")
        if program is None:
            program = plans["steps"] = [(self.found[self.place[field.name]], field.steps(doc, plan)) for field, plan in _program(self.fields, doc, 0)]
        for found, steps in program:
            found.read(doc, 0, steps, row)

    def has(self, at: int, row: int) -> bool:
        """Whether the last page added, number ``row``, has hits of field number ``at``."""
        return self.found[at].places[-1:] == [row]

    def columns(self, kinds: Sequence[pa.ListType], rows: int) -> list[pa.Array]:
        """An array a field, of the ``rows`` pages since the last call."""
        return [found.column(kind, rows) for found, kind in zip(self.found, kinds, strict=True)]


def extract_hits(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    keep: Sequence[str] = ("url",),
    html: str = "html",
    rendered: str | None = None,
    rendered_rules: Sequence[Rule] = (),
    rendered_unless: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``pages`` with ``keep`` columns plus one array column per rule field.

    ``rendered`` names a second page column; ``rendered_rules`` run on it only when
    every field in ``rendered_unless`` came out empty, so it is rarely parsed.
    A NULL page gives empty arrays.
    """
    keep, rules, rendered_rules = list(keep), list(rules), list(rendered_rules)
    hits = T.StructType([*hits_schema(rules).fields, *hits_schema(rendered_rules).fields])
    texts = [html, *([rendered] if rendered else [])]
    # Page columns that are also kept would be sent twice; they are addressed by name.
    source = pages.select(*dict.fromkeys([*keep, *texts]))
    schema = T.StructType([*(source.schema[name] for name in keep), *hits.fields])
    clash = set(keep) & set(hits.fieldNames())
    if clash:
        raise ValueError(f"kept columns share names with rule fields: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        static, second = _Reader(rules), _Reader(rendered_rules)
        unless = [static.place[name] for name in rendered_unless]
        kinds = [field.type for field in to_arrow_schema(hits)]
        own, others = kinds[: len(static.fields)], kinds[len(static.fields) :]
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_PER_BATCH):
                part = batch.slice(start, PAGES_PER_BATCH)
                first = part.column(html).to_pylist()
                other = part.column(rendered).to_pylist() if rendered else [None] * len(first)
                for row, (page, shown) in enumerate(zip(first, other)):
                    static.add(page, row)
                    if shown and not any(static.has(at, row) for at in unless):
                        second.add(shown, row)
                columns = [part.column(name) for name in keep]
                columns += static.columns(own, len(first)) + second.columns(others, len(first))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return source.mapInArrow(run, schema)
