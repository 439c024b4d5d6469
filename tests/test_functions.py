"""Scalar functions on hand-made rows, against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import domain as D
from textloom.functions import quality as Q
from textloom.functions import text as X
from textloom.operators import markup as M


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [
        ("ﬁne  line\there\n12\n½\nab\nabc", "fine line here\nabc"),
        ("a​bc­def ghi\n\n\n\nnext line", "abcdef ghi\nnext line"),
        ("１２３\nfull ４５ width", "full 45 width"),
        ("--\n-----\n------\nabcde", "------\nabcde"),
        ("one\r\ntwo three", "one\ntwo three"),
    ],
)
def test_normalise_content(spark, text, expected):
    assert one(spark, X.normalise_content(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text", ["a b\tc\n d", " x　y z ", "", "   ", "été là"])
def test_words_are_python_split(spark, text):
    assert one(spark, X.words(F.col("t")), t=text) == text.split()


def test_comparison_key_keeps_double_spaces(spark):
    assert one(spark, X.comparison_key(F.col("t")), t=" A - b,\nC! ") == "a  b c"


@pytest.mark.parametrize("word, n", [("table", 1), ("the", 1), ("Idea", 2), ("queue,", 1), ("rhythm", 1), ("!!", 0), ("banana.", 3), ("make", 1)])
def test_syllables(spark, word, n):
    assert one(spark, X.syllables(F.col("t")), t=word) == n


@pytest.mark.parametrize("n_words, n", [(0, 0), (4, 0), (5, 1), (7, 3)])
def test_shingles(spark, n_words, n):
    assert len(one(spark, X.shingles(X.word_tokens(F.col("t"))), t=" ".join(f"w{i}" for i in range(n_words)))) == n


def test_redaction_of_each_kind(spark):
    text = "é.b@c.org 555-123-4567 5551234567 123-45-6789 1234 5678 9012 3456 999.999.999.999 x"
    got = one(spark, D.redact(F.col("t")), t=text)
    assert got == "é[EMAIL] [PHONE] [PHONE] [SSN] [CREDIT_CARD] [IP_ADDRESS] x"


@pytest.mark.parametrize("text, category", [("a database", "research_data"), ("a study", "academic_paper"), ("by design", "technical_document"), ("prose", "general")])
def test_category_by_substring(spark, text, category):
    assert one(spark, D.category(F.col("t")), t=text) == category


def test_gibberish_counts(spark):
    df = Q.with_tokens(spark.createDataFrame([("bcdfghj bcdfghjk " + "#" * 14 + " " + "#" * 15 + r" x\11111111",)], "content string"))
    assert df.select(Q.gibberish_matches(F.col("content"), F.col("tokens"))).first()[0] == 3


def test_gate_reasons_and_precedence(spark):
    rows = [(49, 5, 0), (50, 1, 0), (50, 2, 11), (50, 2, 10)]
    df = spark.createDataFrame(rows, "n int, p int, g int").select(Q.gate_reason(F.col("n"), F.col("p"), F.col("g")).alias("r"))
    assert [r.r for r in df.collect()] == ["No extractable content", "Too few sentences: 1 < 2", "Too much gibberish: 11 matches", None]


@pytest.mark.parametrize("score, grade", [(0.9, "A+"), (0.8999, "A"), (0.7, "B+"), (0.6, "B"), (0.5, "C+"), (0.4, "C"), (0.3999, "D")])
def test_grades(spark, score, grade):
    assert spark.range(1).select(Q.grade(F.lit(score))).first()[0] == grade


def test_scores_without_words_and_with_one_word(spark):
    df = Q.with_scores(Q.with_tokens(spark.createDataFrame([("",), ("same same same",)], "content string")))
    none, one_word = df.collect()
    assert none.overall_score == 0.0 and none.quality_grade == "D"
    assert one_word.information_density == 0.3 and one_word.lexical_diversity == 0.5


@pytest.mark.parametrize(
    "lines, rows",
    [
        (["a\tb", "c\td"], [["a", "b"], ["c", "d"]]),
        (["a|b|c", "d|e"], [["a", "b", "c"], ["d", "e"]]),
        (["a  b  c", "d  e  f"], [["a", "b", "c"], ["d", "e", "f"]]),
        (["a b", "c d"], []),
        (["a|b"], []),
        (["a|b", "c|d", "e|f|g|h|i|j"], []),
        (["a|b", "c|d", "e|f", "g|h", "e|f|g|h|i"], [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"]]),
    ],
)
def test_tables_in_text(spark, lines, rows):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(M.table_of_lines(F.col("l"))).first()[0] == rows


def test_valid_table_share(spark):
    full = [["x"] + [""] * 6, [""] * 7]  # 1 of 14
    more = [["x"] * 2 + [""] * 5, ["none"] + [""] * 5 + ["y"]]  # 3 of 14
    df = spark.createDataFrame([(full,), (more,), ([["a"]],), (None,)], "d array<array<string>>")
    assert [r[0] for r in df.select(M.valid_table(F.col("d"))).collect()] == [False, True, False, False]


def test_markdown_tables_and_equations(spark):
    text = "| a | b |\n| - | - |\n| 1 | 2 |\ntext\n|x|"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert sorted((r.table_no, r.row_count) for r in M.markdown_tables(df, "k", "t").collect()) == [(1, 2), (2, 0)]
    got = one(spark, M.equations(F.col("t")), t="a $x$ b $$y$$")
    assert [(e.type, e.latex) for e in got] == [("inline", x) for x in re.findall(r"\$([^$]+)\$", "a $x$ b $$y$$")] + [("display", "y")]


def test_html_text(spark):
    html = "<html><head><title>t</title></head><body><p>One &amp; two</p><script>x()</script><div>Three<br>four</div></body></html>"
    assert one(spark, M.html_text(F.col("t")), t=html) == "One & two\n\nThree\n\nfour"


def test_images_pages_grid(spark):
    df = spark.sql("SELECT transform(array(array(100, 50), array(103, 52), array(9, 9), array(300, 300)), x -> named_struct('width', x[0], 'height', x[1])) AS i, array(3, 1, 3) AS p, array(1,2,3,4,5,6) AS q")
    row = df.select(F.size(M.near_images(F.col("i"))).alias("n"), M.page_summary(F.col("p")).alias("p"), M.page_summary(F.col("q")).alias("q")).first()
    assert (row.n, row.p, row.q) == (2, "1,3", "P1-6")


def test_syllables_of_whole_texts(spark):
    import random
    import re

    def of(word):
        w = word.lower().strip(".,!?;:")
        n = len(re.findall("[aeiouy]+", w))
        return 0 if not w else max(n - (w.endswith("e") and n > 1), 1)

    rng = random.Random(1)
    texts = ["".join(rng.choice("aeiouybcdt.,!?;: \n\té-E") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.n for r in df.select("k", X.syllables(F.col("t")).alias("n")).collect()}
    assert all(got[k] == sum(map(of, t.split())) for k, t in enumerate(texts)), next((t, got[k], sum(map(of, t.split()))) for k, t in enumerate(texts) if got[k] != sum(map(of, t.split())))


def test_extraction_quality_is_rounded_as_its_sql(spark, tmp_path):
    """Halves away from zero, though the last bits of the arithmetic leave 0.71125 a little below."""
    from textloom.plans import registry

    spark.createDataFrame([(1, "Be the. Thstorsh reen blely er.", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["extraction_quality"](spark, str(tmp_path)).first().overall_quality == 0.7113


def test_low_scores_are_shown_as_python_formats_them(spark):
    from textloom.plans import curation

    df = spark.range(2000, 2500).select((F.col("id") / 10000.0).alias("x"))
    got = df.select("x", curation.low_score(F.col("x"), 0.25).alias("r")).collect()
    assert all(r.r == f"Low quality score: {r.x:.3f} < 0.25" for r in got)


def test_strip_takes_all_white_space_at_the_ends(spark):
    from textloom.functions.patterns import WS, WS_CHARS

    every = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert sorted(every) == sorted(WS_CHARS)
    texts = ["", every, "a", f"{every}a{every}b{every}", " a\n", "\na\r\n\n", "\u200ba\u200b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r.k: r.t for r in df.select("k", X.strip(F.col("t")).alias("t")).collect()} == {k: t.strip() for k, t in enumerate(texts)}


def test_costly_ways_are_not_taken(spark):
    """No comparator of one expression a comparison in an entropy; the pattern of a backslash only where there is one."""
    df = spark.createDataFrame([("x\\11111111 bcdfghjk abc",)], "c string").withColumn("t", X.word_tokens(F.col("c")))
    plan = df.select(X.word_entropy(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    assert df.select(Q.gibberish_matches(F.col("c"), F.col("t"))).first()[0] == 2


def test_filters_make_no_scores_or_tables_again(spark, tmp_path):
    from textloom.plans import registry

    spark.createDataFrame([(1, "a\tb\nc\td", "s"), (2, "no words of a table here", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("quality_gate", "text_pattern_tables"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all("split(" not in line and "sort_array" not in line for line in plan.splitlines() if "Filter" in line), name
    assert [r.doc_id for r in registry.QUERIES["text_pattern_tables"](spark, str(tmp_path)).collect()] == [1]
    assert registry.QUERIES["quality_gate"](spark, str(tmp_path)).first().kept == 2


def test_one_score_does_not_make_the_others(spark):
    """Syllables and the slow class of white space were made for each extraction score; each metric of curation is made once."""
    df = spark.createDataFrame([(1, "One, two words. Three?")], "doc_id long, content string")
    plan = Q.with_extraction_scores(df, "content").select("structural_complexity")._jdf.queryExecution().optimizedPlan().toString()
    assert "aeiouy" not in plan and plan.count("[,;:]") == 1
    plan = Q.with_scores(Q.with_tokens(df)).select("overall_score", "information_density", "structural_quality")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1 and plan.count("Appendix") == 1


def test_white_space_is_looked_up_in_a_table(spark):
    from textloom.functions.patterns import WS

    every = spark.range(0x20, 0xD800).unionByName(spark.range(0, 0x20)).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    got = {r.c for r in every.where(F.col("c").rlike(WS)).collect()}
    assert got == {c for c in map(chr, range(0xD800)) if c.isspace()} and r"\s" not in WS
    assert every.where(F.col("c").rlike(WS) == F.col("c").rlike(X.no_space())).isEmpty()


def test_redaction_tries_patterns_where_they_can_match(spark):
    from textloom.functions import domain as D

    rows = [(1, "a@b.org 5551234567 x5551234567 \u0661\u0662\u0663-555-1234"), (2, "no sign"), (3, None), (4, "10.0.0.1, 123-45-6789; 4111 1111 1111 1111")]
    df = spark.createDataFrame(rows, "k int, t string").select("k", D.redact(F.col("t")).alias("r"))
    assert {r.k: r.r for r in df.collect()} == {1: "[EMAIL] [PHONE] x5551234567 [PHONE]", 2: "no sign", 3: None, 4: "[IP_ADDRESS], [SSN]; [CREDIT_CARD]"}
    assert "contains(" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_numbering_makes_its_input_once(spark):
    from textloom.storage import Tables

    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(k):
        made.add(1)
        return -k

    df = spark.range(100).repartition(3).select("id", seen("id").alias("s"))
    got = Tables(spark, "numbered").numbered(df, [F.col("s")], "n").collect()
    assert sorted((r.id, r.n) for r in got) == [(i, 99 - i) for i in range(100)] and made.value == 100


def test_extraction_quality_at_the_bound_of_a_tenth(spark):
    """Three tenths exactly; the logarithms' last bits made it less, and so a grade F and the third tenth."""
    from textloom.operators.reports import extraction_statistics

    words = ["banana", "potato", "tomato", "canada", "panama", "bahama", "alaska", "arizona"]
    df = spark.createDataFrame([(1, " ".join(w for w in words for _ in range(10))), (2, "")], "doc_id long, content string")
    scored = Q.with_extraction_scores(df, "content").withColumn("extraction_success", F.col("word_count") > 0).withColumn("total_pages", F.lit(1))
    assert [(r.overall_quality, r.extraction_grade) for r in scored.orderBy("doc_id").collect()] == [(0.3, "D"), (0.0, "F")]
    stats = extraction_statistics(scored)
    r = stats.first()
    assert (r.files, r.successful, r.failed, r.elements, r.mean_quality, r.least_quality, r.largest_quality, r.quality_tenths) == (2, 1, 1, 2, 0.15, 0.0, 0.3, {0: 1, 3: 1})
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1
    none = extraction_statistics(scored.where("false")).first()
    assert (none.files, none.successful, none.elements, none.mean_elements, none.mean_quality, none.quality_tenths) == (0, 0, 0, 0.0, None, {})


def test_entropy_of_runs_in_one_pattern(spark):
    """A lambda was called for each word; a run of any length must not recurse."""
    texts = {1: "b a aa a ab b b a", 2: "", 3: "one", 4: " ".join(["x"] * 100_000 + ["xx", "x.y", "\U0001d4b3"] * 3), 5: "$1 \\1 $1 .* .*"}
    df = spark.createDataFrame(list(texts.items()), "k int, t string").withColumn("w", X.words(F.col("t")))
    got = {r.k: r.e for r in df.select("k", X.word_entropy(F.col("w")).alias("e")).collect()}

    def entropy(words):
        counts = [words.count(w) for w in set(words)]
        return sum(-c / len(words) * math.log2(c / len(words)) for c in counts)

    assert got.pop(2) is None and got == pytest.approx({k: entropy(t.split()) for k, t in texts.items() if t}, abs=1e-9)
    plan = df.select(X.word_entropy(F.col("w")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "prior" not in plan


def test_markers_and_terms_are_counted_once(spark):
    from textloom.functions import domain as D
    from textloom.functions import patterns as P

    words = "Table figure SECTION chapter Appendix reference References Fig Eq equation page vol Volume No. Number No nu. 1 7"
    df = spark.createDataFrame([(words + " data research",)], "content string")
    counts = [F.regexp_count("content", F.lit("(?i)" + start + P.STRUCTURED_MARKERS)) for start in ("", P.MARKER_START)]
    assert len(set(df.select(*[c.alias(str(k)) for k, c in enumerate(counts)]).first())) == 1
    scored = Q.with_scores(Q.with_tokens(df)).withColumn("r", D.relevance(F.size("words"), F.col("term_count")))
    assert scored.first().term_count == 6  # table, figure, equation, data, and research as both
    plan = scored.select("overall_score", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count(" INSET ") == 2, plan
