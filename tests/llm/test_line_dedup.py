"""Recurring lines against plain Python."""

import random
import re
from collections import Counter, defaultdict

from shelfmark.llm import line_dedup as L


def shape(line):
    return " ".join("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))


def brute(rows, min_docs=3):
    """[(id, text, lines, dropped)] by the docstring's rules; ids are unique."""
    held = [(i, s) for i, text in rows for s in {shape(x) for x in (text or "").split("\n")} - {""}]
    docs = Counter(s for _, s in held)
    leaf = {s: (len(s.split(" ")), tuple(s.split(" ")[: L.LEADING])) for s in docs}
    seen = Counter()
    for s, n in docs.items():
        for at, token in enumerate(s.split(" ")):
            seen[leaf[s], at, token] += n
    pattern = {}
    for s in docs:
        tokens = s.split(" ")
        fixed = [t if t != "<*>" and seen[leaf[s], at, t] >= min_docs else None for at, t in enumerate(tokens)]
        if 100 * sum(t is not None for t in fixed) >= 50 * len(tokens):
            pattern[s] = (leaf[s], tuple(fixed))
    holders = defaultdict(set)
    for i, s in held:
        if s in pattern:
            holders[pattern[s]].add(i)
    gone = {s for s, p in pattern.items() if len(holders[p]) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if shape(x) not in gone]
        out.append((i, "\n".join(stay) if text is not None else None, sum(shape(x) != "" for x in lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in frame.collect()), key=str)


def corpus(seed, n=150):
    random.seed(seed)
    names = ["ann", "bob", "cy", "dee", "eve", "flo"]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(random.choice([0, 1, 4, 9])):
            lines.append(
                random.choice(
                    [
                        "Posted by user %d on 2024-0%d-11" % (random.randrange(99), random.randrange(9)),
                        "The page was last seen by %s at noon" % random.choice(names),
                        "All rights  reserved.\t",
                        "unique %s" % " ".join(random.choices(names, k=random.choice([3, 6, 9]))),
                        "12 34 56 78",
                        "",
                        "  ",
                        "x\x0b y",
                        "The page was last %s" % " ".join(random.choices(names, k=6)),
                    ]
                )
            )
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "All rights reserved."), (1004, "word " * 100_000 + "\nkept é 日")]
        assert found(L.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))) == brute(rows)


def test_templates_cover_variable_fields(spark):
    lines = [f"Contact {name} for any further question about it" for name in ("ann", "bob", "cy", "dee")]
    rows = [(i, f"own line number{'x' * i}\n{line}") for i, line in enumerate(lines)]
    assert all(r.n_dropped == 0 for r in L.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect())  # the second token leads
    late = [(i, f"own {'x' * i}\nFor any further question ask {name} about all of it") for i, name in enumerate(("ann", "bob", "cy", "dee"))]
    assert all(r.n_dropped == 1 for r in L.line_dedup(spark.createDataFrame(late, "doc_id int, text string")).collect())


def test_one_document_alone_repeats_nothing(spark):
    rows = [(1, "same line here now\n" * 50), (2, "other")]
    assert {r.n_dropped for r in L.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()} == {0}


def test_null_ids_repeated_rows_and_columns(spark):
    rows = [(None, "a b c d e", 1), (1, "a b c d e", 2), (1, "a b c d e", 2), (2, None, 3)]
    twice = L.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int"))
    assert {r.n_dropped for r in twice.collect()} == {0}  # two documents hold it
    rows[0:0] = [(4, "a b c d e", 1)]
    frame = L.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int"))
    assert frame.columns == ["doc_id", "text", "n_lines", "lines_n_lines", "n_dropped"]
    found = sorted((str(r.doc_id), r.text, r.n_lines, r.lines_n_lines, r.n_dropped) for r in frame.collect())
    assert found == [("1", "", 2, 1, 1), ("1", "", 2, 1, 1), ("2", None, 3, 0, 0), ("4", "", 1, 1, 1), ("None", "", 1, 1, 1)]


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = L.line_dedup(spark.createDataFrame([(1, "a")], "doc_id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
