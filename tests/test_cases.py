"""Small cases with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as tx
from quarryline.functions import titles as tt
from quarryline.operators import cells, evidence, gates, grading, layout, reads, search, sensors, stats, toc, traces
from quarryline.plans import index, manifest
from quarryline.sources import files


def _outline(spark, entries, total):
    return spark.createDataFrame([("d", k, level, title, page, total) for k, (level, title, page) in enumerate(entries, 1)], "doc_id string, seq long, level int, title string, start_page long, total_pages long")


@pytest.mark.parametrize(
    ("entries", "total", "ends"),
    [
        ([(1, "Overview", 1), (1, "Block Diagram", 5), (1, "Pin Configuration", 6), (1, "Electrical Characteristics", 10)], 20, [4, 5, 9, 20]),
        ([(1, "16", 50), (2, "16.1", 51), (3, "16.1.1", 53), (3, "16.1.2", 53), (3, "16.1.3", 55), (2, "16.2", 55)], 73, [73, 54, 53, 54, 55, 73]),
    ],
)
def test_end_pages(spark, entries, total, ends):
    tree = toc.build_tree(_outline(spark, entries, total))
    assert [r["end_page"] for r in tree.orderBy("seq").collect()] == ends


def test_tree_drops_and_moves_up(spark):
    tree = toc.build_tree(_outline(spark, [(1, " A ", 1), (2, "B", 0), (3, "C", 2), (1, "Revision History", 9), (2, "D", 9)], 9)).orderBy("seq").collect()
    assert [(r["node_id"], r["breadcrumb"], r["boilerplate_category"]) for r in tree] == [("0001", "A", ""), ("0002", "A > C", ""), ("0003", "Revision History", "revision"), ("0004", "Revision History > D", "revision")]
    with pytest.raises(Exception, match="level"):
        toc.valid_entries(_outline(spark, [(0, "x", 1)], 3)).collect()


def test_deepest_section_and_sums(spark):
    tree = toc.build_tree(_outline(spark, [(1, "A", 1), (2, "B", 2), (2, "C", 2), (1, "D", 5)], 6))
    found = {r["page"]: r["breadcrumb"] for r in toc.deepest_for_page(tree).collect()}
    assert found == {1: "A", 2: "A > B", 3: "A > C", 4: "A > C", 5: "D", 6: "D"}
    pages = spark.createDataFrame([("d", 2, 3), ("d", 6, 1)], "doc_id string, page long, table_count int")
    assert [r["table_count"] for r in toc.sum_over_ranges(tree, pages, "table_count").orderBy("seq").collect()] == [3, 3, 3, 1]


def test_quality(spark):
    same = toc.quality(toc.build_tree(_outline(spark, [(1, f"Section {k}", k) for k in range(1, 50)], 49))).first()
    assert same["score"] == pytest.approx(0.016, abs=2e-3) and same["recommend_summaries"]
    good = toc.quality(toc.build_tree(_outline(spark, [(1, "Alpha", 1), (2, "Beta", 2), (2, "Gamma", 3), (1, "Delta", 4), (2, "Epsilon", 5), (2, "Zeta", 6), (1, "Eta", 7)], 8))).first()
    assert good["score"] > 0.6


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_furniture_keys(spark):
    assert _one(spark, tx.furniture_key(F.lit("  Datasheet   46 \n 002-23185 Rev. *S  "))) == "Datasheet # #-# Rev. *S"
    for text, ok in (("Table 43 (continued) x", False), ("Fig. 3 timing", False), ("Chart 2", False), ("Tablet computer interface", True), ("x" * 200, True), ("x" * 201, False), ("  ", False)):
        assert _one(spark, tx.may_be_furniture(F.lit(text))) is ok


def test_furniture_routes(spark):
    keys = [("d", p, "all") for p in range(1, 21)] + [("d", p, "odd") for p in range(1, 21, 2)] + [("d", p, "few") for p in (1, 3)] + [("d", p, "#") for p in range(1, 21)]
    found = layout.furniture(spark.createDataFrame(keys, "doc string, page int, key string"), "doc", "page", "key", spark.createDataFrame([("d", 20)], "doc string, total_pages int"))
    assert {r["key"] for r in found.collect()} == {"all", "odd"}


def test_two_columns(spark):
    blocks = [("d", 1, k, *b, 0, 600.0, 800.0) for k, b in enumerate([(320.0, 100.0, 570.0, 300.0), (20.0, 100.0, 280.0, 300.0), (20.0, 20.0, 580.0, 60.0), (20.0, 700.0, 580.0, 750.0)])]
    rows = layout.reading_order(spark.createDataFrame(blocks, "doc_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, block_type int, page_width double, page_height double"))
    assert [r["block_no"] for r in rows.orderBy("place").collect()] == [2, 1, 0, 3]


def test_annotations(spark):
    assert _one(spark, tx.footnote_marks(F.lit("1) 2) Note 3 (4) (21)"))) == ["1)", "2)", "4)", "21)", "Note 3", "(4)"]
    refs = _one(spark, tx.cross_references(F.lit("See Figure 3-1 and refer to Table 5. see Section 5.2 now, see Figure 3-1")))
    assert [tuple(r) for r in refs] == [("figure", "Figure 3-1"), ("table", "Table 5"), ("section", "5.2")]
    assert _one(spark, tx.continued_tables(F.lit("Table 12 Limits (Continued)"))) == ["Table 12 Limits"]


@pytest.mark.parametrize(
    ("title", "rule"),
    [
        ("PSC3P5xD, PSC3M5xD 32-bit Arm Cortex-M33", "wildcard"), ("PIC16F882/883/884/886/887 Data Sheet", "slash-list"), ("1N4001, 1N4002, 1N4003 Rectifier", "list"),
        ("LM111, LM211, LM311 Voltage Comparator", "near-identical"), ("ESP32 Series Datasheet", "series"), ("BME280 Combined humidity and pressure sensor", None), ("Series Resistance Measurement", None), ("", None),
        ("Arm Cortex-M4 Series Manual", None), ("TPS7A4901 TPS7A4901DGNR", None),
    ],
)
def test_families(spark, title, rule):
    found = _one(spark, tt.family(F.lit(title)))
    assert (found and found["rule"]) == rule


@pytest.mark.parametrize(
    ("title", "name"),
    [("Revision History", "revision"), ("Important Notice", "legal"), ("Ordering Information (Continued)", "ordering"), ("Package Outlines", "mechanical"), ("Contents", "toc"), ("Glossary", "glossary"), ("Contact Information", "contact"), ("Electrical Characteristics", ""), ("Appendix A: 1. Ordering Information: (cont.).", "ordering"), ("Civil Index", ""), ("3.Ordering Information", "ordering"), ("A)Glossary", "glossary"), ("a. Glossary", "glossary"), ("12.3.4 Revision History", "revision"), ("A Glossary of Terms", ""), ("Annex B - Trademarks;", ""), ("Index (Continued):", "toc"), ("\u00a02: Contents\t", "toc"), ("", ""), ("...", "")],
)
def test_boilerplate(spark, title, name):
    assert _one(spark, tt.boilerplate_class(F.lit(title))) == name


def _search(spark, pages, *patterns):
    p = spark.createDataFrame([(k, x) for k, x in enumerate(patterns)], "pattern_id int, pattern string")
    t = spark.createDataFrame([(1, k, x) for k, x in enumerate(pages, 1)], "doc_id long, page long, page_text string")
    return [(r["page"], r["start"], r["end"], r["level"]) for r in search.search(t, p).orderBy("page", "start").collect()]


def test_search_levels(spark):
    assert _search(spark, ["Alpha beta", "Alpha beta gamma"], "alpha Beta") == [(1, 0, 10, 1), (2, 0, 10, 1)]
    assert _search(spark, ["Transmitted recessive bit\nwidth at 5 Mbit/s"], "Transmitted recessive bit width at 5 Mbit/s") == [(1, 0, 43, 2)]
    assert _search(spark, ["Transmitted recessive bit tBit(Bus)_5M 155 170 210 ns width at 5 Mbit/s"], "Transmitted recessive bit width at 5 Mbit/s")[0][::3] == (1, 3)
    assert _search(spark, ["a+b (c) \\E d"], "(c) \\E D") == [(1, 4, 12, 1)]
    with pytest.raises(Exception, match="empty"):
        _search(spark, ["x"], " ")


def test_search_takes_odd_rows(spark):
    assert _search(spark, ["xfoo  bar", None, ""], " foo bar") == [(1, 1, 9, 2)]
    assert _search(spark, ["a\u2014b A-B"], "a-B") == [(1, 0, 3, 1), (1, 4, 7, 1)]
    assert _search(spark, ["aaaa"], "aa") == [(1, 0, 2, 1), (1, 2, 4, 1)]
    assert _search(spark, ["\u0130stanbul \u017fo"], "stanbul so") == [(1, 1, 11, 1)]
    assert _search(spark, ["one two"], *[]) == []
    t = spark.createDataFrame([(1, 1, "x")], "doc_id long, page long, page_text string")
    many = spark.range(search.MOST_PATTERNS + 1).selectExpr("id AS pattern_id", "cast(id AS string) AS pattern")
    with pytest.raises(ValueError, match="more than"):
        search.search(t, many)


def _plain_search(pages, pattern):
    """The three levels one after another, page by page, as they are meant."""
    import re

    fold = lambda x: re.sub("[‐‑‒–—―−]", "-", x).lower()
    first = [(k, m.start(), m.end(), 1) for k, t in enumerate(pages, 1) for m in re.finditer(re.escape(fold(pattern)), fold(t))]
    words = fold(pattern).split()
    if first or len(words) < 2:
        return first
    second = [(k, m.start(), m.end(), 2) for k, t in enumerate(pages, 1) for m in re.finditer(r"\s+".join(map(re.escape, words)), fold(t))]
    if second or len([w for w in words if w.strip(".,;:!?")]) < 3:
        return second
    found = []
    for k, t in enumerate(pages, 1):
        tokens = [(m.group().strip(".,;:!?"), m.start(), m.end()) for m in re.finditer(r"\S+", fold(t))]
        tokens = [x for x in tokens if x[0]]
        wanted = [w for w in (w.strip(".,;:!?") for w in words) if w]

        def last(at, rest, tokens=tokens):
            if not rest:
                return at
            for j in range(at + 1, min(at + max(8, 2 * len(wanted)) + 2, len(tokens))):
                if tokens[j][0] == rest[0] and (end := last(j, rest[1:])) is not None:
                    return end
            return None

        found += [(k, tokens[a][1], tokens[b][2], 3) for a in range(len(tokens)) if tokens[a][0] == wanted[0] and (b := last(a, wanted[1:])) is not None]
    return found


def test_search_against_plain_search(spark):
    """Many patterns over many documents at once: each answer is that of the pattern and the document alone."""
    import random

    rng = random.Random(11)
    words = ["a", "B", "ab", "c.", "d-e", "d–e", "(x"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(n))
    docs = {d: [text(rng.randint(0, 14)) for _ in range(3)] for d in range(30)}
    asked = sorted({text(rng.randint(1, 4)).strip() for _ in range(40)})
    pages = spark.createDataFrame([(d, k, t) for d, ps in docs.items() for k, t in enumerate(ps, 1)], "doc_id long, page long, page_text string")
    patterns = spark.createDataFrame(list(enumerate(asked)), "pattern_id long, pattern string")
    got = sorted((r["pattern_id"], r["doc_id"], r["page"], r["start"], r["end"], r["level"]) for r in search.search(pages, patterns, None).collect())
    assert got == sorted((i, d, *x) for i, p in enumerate(asked) for d, ps in docs.items() for x in _plain_search(ps, p))
    top = search.search(pages, patterns, 3).groupBy("pattern_id").count().collect()
    assert {r["pattern_id"]: r["count"] for r in top} == {i: min(3, sum(x[0] == i for x in got)) for i in {x[0] for x in got}}
    once = search.distinct_spans(search.search(pages, patterns, None), 5).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in once} == {d: min(5, len({x[2:5] for x in got if x[1] == d})) for d in {x[1] for x in got}}


def test_ordered_tokens_against_brute_force():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(300):
        tokens = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        wanted = [rng.choice("abc") for _ in range(3)]
        gap = rng.randint(0, 4)
        for first in range(len(tokens)):
            if tokens[first] != wanted[0]:
                continue
            ways = [w for w in itertools.combinations(range(first, len(tokens)), 3) if w[0] == first and [tokens[k] for k in w] == wanted and all(b - a - 1 <= gap for a, b in itertools.pairwise(w))]
            assert search.ordered_span(tokens, wanted, first, gap) == (min(ways)[-1] if ways else None)


def test_headings(spark):
    at = lambda text, title: _one(spark, search.heading_offset(F.lit(text), F.lit(title)))
    assert at("4 Ordering\nrow", "Ordering") == 0
    assert at("See 2 Foo for details.", "Foo") is None
    text = "Pressure 300 1100 hPa\nmore tail\nPressure\nrow"
    assert at(text, "Pressure") == text.index("\nPressure\n") + 1
    assert _one(spark, search.continued(F.lit("row B\n3 Limits\nrow C"), search.heading_offset(F.lit("row B\n3 Limits\nrow C"), F.lit("Limits")))) == "row B"


PAGES = [(1, 1, "Alpha\nrow 1\nBeta\nrow 2"), (1, 2, "row 3\n2 Gamma\nrow 4"), (1, 3, "Delta\nTable 1 (continued)\nrow 5"), (1, 4, "row 6\nrow 7")]
SECTIONS = [(1, 1, 1, "Alpha", 1, 1, [1], "Alpha"), (1, 2, 1, "Beta", 1, 2, [2], "Beta"), (1, 3, 2, "Gamma", 2, 2, [2, 3], "Beta > Gamma"), (1, 4, 1, "Delta", 3, 4, [4], "Delta"), (1, 5, 1, "Epsilon", 4, 4, [5], "Epsilon")]


def _document(spark, pages=PAGES, sections=SECTIONS):
    p = spark.createDataFrame(pages, "doc_id long, page long, page_text string")
    return p, spark.createDataFrame(sections, "doc_id long, seq long, level int, title string, start_page long, end_page long, path array<long>, breadcrumb string").withColumn("lineage", F.transform("path", lambda s: F.struct(s.alias("seq"), F.get(F.array(*[F.lit(x[3]) for x in sections]), s.cast("int") - 1).alias("title"))))


def _read(spark, first, last, families=None):
    pages, sections = _document(spark)
    ranges = spark.createDataFrame([(7, 1, first, last)], "range_id long, doc_id long, first_page long, last_page long")
    known = spark.createDataFrame(families, "doc_id long, family string") if families else None
    return reads.section_reads(pages, sections, ranges, known).first()["text"]


def test_section_reads(spark):
    """A range goes on to the next heading; text above its own first heading is marked; a heading that is not found leaves a note."""
    assert _read(spark, 1, 1) == '=== Page 1 of 4 ===\n--- PAGE 1 ---\nAlpha\nrow 1\nBeta\nrow 2\n=== Continued from the top of page 2, up to the next section heading "Gamma" ===\n--- PAGE 2 ---\nrow 3'
    assert _read(spark, 2, 2) == '=== Page 2 of 4 ===\n=== NOTE: "Table 1" is continued on page 3, which is outside this range. ===\n--- PAGE 2 ---\nrow 3\n=== SECTION STARTS: Gamma (text above is the previous section\'s) ===\n2 Gamma\nrow 4'
    three = _read(spark, 3, 3)
    assert three.startswith('=== Page 3 of 4 ===\n=== NOTE: this range opens inside "Table 1", which is continued from page 2. ===\n=== NOTE: a section starts on page 4, but')
    assert _read(spark, 3, 4) == '=== Pages 3-4 of 4 ===\n=== NOTE: this range opens inside "Table 1", which is continued from page 2. ===\n--- PAGE 3 ---\nDelta\nTable 1 (continued)\nrow 5\n--- PAGE 4 ---\nrow 6\nrow 7'
    assert "product family (X1, X2). Do NOT report" in _read(spark, 4, 4, [(1, "X1, X2")]) and "product family. Do NOT" in _read(spark, 4, 4, [(1, None)])
    for first, last in ((0, 1), (2, 1), (4, 5)):
        with pytest.raises(Exception, match="no such range"):
            _read(spark, first, last)


def test_family_notes_name_places(spark):
    sections = [(1, 1, 1, "Device Comparison", 1, 1, [1], "x"), (1, 2, 1, "Ordering Information", 2, 3, [2], "x"), (1, 3, 2, "Selection Guide", 3, 3, [2, 3], "x"), (1, 4, 1, "Nomenclature", 4, 4, [4], "x"), (1, 5, 1, "Revision History", 4, 4, [5], "x"), (1, 6, 2, "Device Comparison", 4, 4, [5, 6], "x")]
    pages, table = _document(spark, [(1, k, "text") for k in range(1, 6)], sections)
    found = reads.evidence(table).first()
    # the ordering chapter holds the selection guide, which has the higher rank and is shown for both
    assert [e["title"] for e in found["shown"]] == ["Device Comparison", "Selection Guide", "Nomenclature"] and len(found["resolving"]) == 3
    note = lambda a, b: reads.section_reads(pages, table, spark.createDataFrame([(1, 1, a, b)], "range_id long, doc_id long, first_page long, last_page long"), spark.createDataFrame([(1, "")], "doc_id long, family string")).first()["text"]
    assert "product family" not in note(2, 3) and "product family" not in note(1, 1)
    assert '"Device Comparison" (page 1); "Selection Guide" (page 3); "Nomenclature" (page 4)' in note(5, 5)
    assert '"Device Comparison" (page 1); "Selection Guide" (page 3), and search' in note(4, 4)


@pytest.mark.parametrize(
    ("text", "titles", "places"),
    [("Limits\nrow\nLimits\nrow", ["Limits", "Limits", "Limits"], [0, 11, None]), ("Pressure 300\n1.4 Pressure MIN\nrow", ["Pressure"], [13]), ("see 3 Thermal limits", ["Thermal limits"], [None]), ("  Chapter 1 ULP\n Coprocessor\nx", ["ULP Coprocessor"], [0]), ("A-1 Notes\nx", ["notes"], [0]), ("x", [""], [None]), ("a b\nb", ["b"], [4])],
)
def test_placed_headings(text, titles, places):
    assert reads.placed(text, titles) == places


def test_sections_of_matches(spark):
    pages, sections = _document(spark)
    heads = reads.headings(sections, pages)
    matches = spark.createDataFrame([(1, 1, 0), (1, 1, 14), (1, 2, 0), (1, 2, 8), (1, 3, 9), (1, 4, 3), (2, 1, 0)], "doc_id long, page long, start long")
    got = {(r["doc_id"], r["page"], r["start"]): r["breadcrumb"] for r in reads.breadcrumbs_of_matches(matches, sections, heads).collect()}
    assert got == {(1, 1, 0): "Alpha", (1, 1, 14): "Beta", (1, 2, 0): "Beta", (1, 2, 8): "Beta > Gamma", (1, 3, 9): "Delta", (1, 4, 3): "Delta", (2, 1, 0): None}


def test_replies():
    from quarryline.functions import replies

    assert replies.reply_json(' {"a": 1} ') == '{"a": 1}' and replies.reply_json(None) is None and replies.reply_json("no") is None
    assert replies.reply_json("x\n```json\n[1]\n``` y") == "[1]" and replies.reply_json("```\n{}\n```") == "{}"
    import json

    reply = r'Out(a="True = None\" x=(", b=[True, {"c": None}], d = False, e=1)'
    assert json.loads(replies.reply_json(reply)) == {"a": 'True = None" x=(', "b": [True, {"c": None}], "d": False, "e": 1}
    for broken in ("Out(a='x')", "Out(a=Inner(b=1))", "Out(a=1", "Out(a==1)"):
        assert replies.reply_json(broken) is None


def test_gates_without_inputs(spark):
    """A run without a base or traces: those gates have no value and do not fail; without cells of the engine nothing was found."""
    schema = "claim_id int, engine string, model string, overall_pass boolean, found_correct boolean, found_expected boolean, value_pass boolean, confidence double, engine_error string, repro_error string, verdict string, status string, measured_value double, sigma_basis string, n_steps int, n_tool_calls_by_tool map<string,int>, n_tool_errors_by_tool map<string,int>"
    cell = lambda model, engine, **x: tuple({"claim_id": 1, "engine": engine, "model": model, "overall_pass": True, "found_correct": True, "found_expected": True, "value_pass": True, "confidence": 0.9, "verdict": "pass", "status": "ok", "n_steps": 3, "n_tool_calls_by_tool": {"search_text": 2}, **x}.get(c.split()[0]) for c in schema.replace("<string,int>", "").split(", "))
    rows = spark.createDataFrame([cell("a", "agentic"), cell("b", "baseline"), cell("c", "agentic", measured_value=float("inf"), sigma_basis="typical"), cell("d", "agentic", n_tool_calls_by_tool={"get_section_text": 1}, measured_value=float("nan"), sigma_basis="STUB")], schema)
    found = {r["model"]: (r["exit_code"], r["hard_failures"], r["warnings"]) for r in gates.outcome(gates.gate_rows(rows)).collect()}
    assert found == {"a": (0, [], []), "b": (1, ["H1_found_accuracy"], []), "c": (1, ["H5_protocol_errors"], []), "d": (2, [], ["S9_silent_failures"])}
    assert gates.gate_rows(rows.filter("false")).count() == 0


def test_released_folders(spark, tmp_path):
    import os

    from quarryline.session import release, shared_folder

    folder = shared_folder(spark, "gone")
    spark.range(3).write.parquet(folder)
    assert os.path.isdir(folder.removeprefix("file:"))
    assert release(spark) >= 1 and not os.path.isdir(folder.removeprefix("file:"))


def test_guard_lets_other_errors_through(monkeypatch):
    import __spark_entry__

    def broken(name):
        raise ModuleNotFoundError(f"no {name}", name="zstandard")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._optional("quarryline.llm.queries")


def test_captions(spark):
    page = "Figure 1.2-1 shows x\nFig. 1 - Forward Current\nFigure 7\n\nBlock diagram\nFigure 17-12.Prescaler"
    rows = layout.captions(spark.createDataFrame([(1, page)], "page int, page_text string"), "page").orderBy("line").collect()
    assert [(r["figure_number"], r["title"]) for r in rows] == [("1", "Forward Current"), ("7", "Block diagram"), ("17-12", "Prescaler")]


def test_chunks_and_front_matter(spark):
    pages = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([10, 10, 25, 3, 3], 1)], "doc_id int, page int, page_text string")
    assert [r["chunk"] for r in layout.chunks(pages, size=20).orderBy("page").collect()] == [1, 1, 2, 3, 3]
    two = spark.createDataFrame([(1, 1, "ab\ncd"), (1, 2, "efgh")], "doc_id int, page int, page_text string")
    assert layout.front_matter(two, max_chars=4).first()["text"] == "--- PAGE 1 ---\nab"
    assert layout.front_matter(two, max_chars=9).first()["chars_shown"] == 9


def test_verdict_sweep(spark):
    row = spark.createDataFrame([(945.285, 0.0801, 0.0, 300.0, 1200.0)], "m double, s double, t double, lo double, claimed_max double")
    swept = sensors.sweep(row, 0.787, 0.7885, 31)
    v = sensors.verdict(F.col("m"), F.col("s"), F.col("t"), F.lit(0.0), F.col("lo"), F.col("claimed_max"), F.lit(None).cast("double"), F.lit(False), F.lit(False))
    got = [(r["claimed_max"], r["v"]) for r in swept.select("k", "claimed_max", v.alias("v")).orderBy("k").collect()]
    for bound, verdict in got:
        assert verdict == ("pass" if bound >= 945.285 else "inconclusive" if 945.285 - bound <= 0.0801 else "fail")
    nan = F.lit(float("nan"))
    assert _one(spark, sensors.verdict(nan, nan, F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(False))) == "inconclusive"


def test_conditions(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.001), (2, 5.0), (2, None), (3, float("nan"))], "k int, v double")
    held = {r["k"]: r["ok"] for r in rows.groupBy("k").agg(sensors.holds(F.col("v"), F.lit(5.0), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("ok")).collect()}
    assert held == {1: True, 2: False, 3: False}


def test_statistics(spark):
    got = spark.range(1, 6).agg(F.percentile("id", F.lit(0.05)).alias("p05"), stats.nearest_rank("id", 0.9).alias("p90")).first()
    assert got["p05"] == pytest.approx(1.2) and got["p90"] == 5
    pairs = [(1, 1)] * 21 + [(1, 0)] * 3 + [(0, 0)] * 3
    assert stats.kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()["kappa"] == pytest.approx(0.6087, abs=1e-4)
    assert _one(spark, stats.upper_bound(F.lit(0), F.lit(25))) == pytest.approx(11.29, abs=0.01)
    with pytest.raises(Exception, match="0 of n"):
        _one(spark, stats.upper_bound(F.lit(1), F.lit(25)))


def test_variance(spark):
    rows = [("m", r, k, k < n, 0.9, 1.0, "") for r, n in ((1, 23), (2, 19), (3, 15)) for k in range(25)]
    got = cells.variance(spark.createDataFrame(rows, "model string, repeat int, claim_id int, overall_pass boolean, confidence double, latency_s double, engine_error string")).first()
    assert got["passes_mean"] == 19 and got["passes_std"] == 4
    one = cells.variance(spark.createDataFrame(rows[:25], "model string, repeat int, claim_id int, overall_pass boolean, confidence double, latency_s double, engine_error string")).first()
    assert one["passes_std"] is None


@pytest.mark.parametrize(("calls", "flags"), [({"submit_claim_result": 1}, ["tool_bypass"]), ({"get_section_text": 3}, ["verification_skipped"]), ({"get_section_text": 3, "search_text": 1}, []), ({"query_dataset": 2}, ["tool_bypass"])])
def test_silent_failures(spark, calls, flags):
    column = F.create_map(*[F.lit(x) for pair in calls.items() for x in pair])
    assert _one(spark, traces.silent_failure(F.lit(True), column)) == flags
    assert _one(spark, traces.silent_failure(F.lit(False), column)) == []


def test_grading(spark):
    hit = lambda text, needle: _one(spark, grading.needle_hit(F.lit(text), F.lit(needle)))
    assert hit("max 1,200 mV", "1200") and not hit("max 12000 mV", "1200") and hit("Supply Voltage", "voltage")
    assert _one(spark, grading.list_share(F.array(F.lit("SPI bus"), F.lit("I2C")), F.array(F.lit("spi"), F.lit("i2c"), F.lit("uart")))) == pytest.approx(2 / 3)
    assert _one(spark, grading.graded(F.lit(None).cast("boolean"), F.lit(False), F.lit(None).cast("double"), F.lit(False)))["overall_pass"]


def test_ranked_evidence(spark):
    rows = spark.createDataFrame([("d", 0, 5, 9), ("d", 1, 6, 7), ("d", 1, 10, 12), ("d", 2, 1, 20)], "doc_id string, rank int, a long, b long")
    assert [(r["a"], r["b"]) for r in evidence.ranked(rows, 5).orderBy("place").collect()] == [(5, 9), (10, 12)]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("A b.pdf", "sub/c.PDF", "d.txt"):
        (tmp_path / name).write_bytes(b"%PDF-")
    assert {r["path"].rpartition("/")[2].replace("%20", " ") for r in files.listing(spark, str(tmp_path)).collect()} == {"A b.pdf", "c.PDF"}
    stems = files.unique_stems(spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2"), (4, "x")], "n int, s string"), "s", "n")
    assert len({r["stem"] for r in stems.collect()}) == 4


def test_manifest_and_index(spark):
    docs = spark.createDataFrame([(1, "Figure 1: A\n* b"), (2, None), (3, "")], "doc_id long, text string")
    rows = manifest.fingerprint(docs, "o").withColumn("complete", F.lit(True))
    assert manifest.to_build(docs, rows, "o").count() == 0
    assert manifest.to_build(docs, rows, "p").count() == 3
    got = {r["doc_id"]: (r["pages"], r["bullets"], r["captions"]) for r in index.manifest(docs).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 0, 0), 3: (1, 0, 0)}  # a null text is one empty page


def test_stratified_sample(spark):
    """Arms of 100, 60 and 2 rows get 4, 4 and 2 of 11: the rest goes to the largest arm, small ones give all."""
    rows = [("a", k % 25, k) for k in range(100)] + [("b", k % 3, 200 + k) for k in range(60)] + [("c", None, 300), ("c", 1, 301)]
    table = spark.createDataFrame(rows, "arm string, stratum long, id long")
    got = stats.stratified(table, 11, "arm", "stratum", "id", 7).collect()
    counts = {a: sum(r["arm"] == a for r in got) for a in "abc"}
    assert counts == {"a": 4, "b": 4, "c": 2} and len({r["id"] for r in got}) == 10
    assert stats._shares([50, 30, 20], 10) == [5, 3, 2]
    assert stats._shares([10] * 25, 12) == [1] * 12 + [0] * 13
    assert stats._shares([1, 1, 98], 99) == [1, 1, 97]
    assert {r["id"] for r in stats.stratified(table.repartition(7), 11, "arm", "stratum", "id", 7).collect()} == {r["id"] for r in got}
    assert stats.stratified(table.filter("false"), 11, "arm", "stratum", "id", 7).count() == 0


def test_stratified_query_has_its_rows(spark, sf):
    from quarryline.queries import QUERIES

    assert QUERIES["w12_stratified_sample"](spark, sf).count() == 60
