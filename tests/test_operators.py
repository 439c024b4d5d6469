"""Relational operators: replay and joins against plain loops, monitors, vocabulary, embeddings, readers."""

import hashlib
import itertools
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import dedup, embeddings, evaluation, reports, tfidf, tokens, training, vocabulary
from textloom.plans import curation
from textloom.sources import readers, writers
from textloom.storage import Tables


def sequential(n, similar, score):
    gone = set()
    for i in range(n):
        for j in range(i + 1, n):
            if i in gone:
                break
            if j in gone or (i, j) not in similar:
                continue
            gone.add(j if score[i] >= score[j] else i)
    return gone


def test_replay_is_the_sequential_loop():
    rng = random.Random(7)
    for _ in range(500):
        n = rng.randint(2, 10)
        similar = {p for p in itertools.combinations(range(n), 2) if rng.random() < 0.3}
        score = [rng.choice([0.3, 0.4, 0.5]) for _ in range(n)]
        pairs = pd.DataFrame([(i, j, 1.0, score[i], score[j]) for i, j in similar], columns=["i", "j", "similarity", "q_i", "q_j"])
        assert set(dedup.replay(pairs)["removed"]) == sequential(n, similar, score)


def test_fuzzy_removals_by_component(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, base + " x", "other " * 6 + " ".join(f"v{i}" for i in range(50)), base + " x y", "short"]
    df = spark.createDataFrame([(i, t, 0.5 + 0.1 * (i == 1)) for i, t in enumerate(texts)], "ord long, content string, overall_score double")
    got = {r.removed: r.logged for r in dedup.fuzzy_removals(df, Tables(spark, "t")).collect()}
    assert got == {0: False, 3: True}  # the earlier of (0, 1) has the lower score and goes unlogged


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85])
def test_similar_sets_loses_no_pair(spark, threshold):
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(60)]
    sets += [sets[5], sets[6]]
    df = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(sets)], "ord long, shingles array<long>, n int")
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    expected = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if j(sets[a], sets[b]) >= threshold}
    tables = Tables(spark, "t")
    assert {(r.i, r.j) for r in dedup.expanded(*dedup.fuzzy_pairs(df, threshold, tables)).collect()} == expected


def test_tfidf_drops_terms_of_all_documents(spark):
    df = spark.createDataFrame([(0, "alpha beta gamma"), (1, "alpha beta delta")], "ord long, content string")
    assert {r.term for r in tfidf.tfidf_weights(df).collect()} == {"beta gamma", "alpha beta gamma", "beta delta", "alpha beta delta"}
    same = spark.createDataFrame([(0, "alpha beta"), (1, "alpha beta")], "ord long, content string")
    assert tfidf.similar_vectors(tfidf.tfidf_weights(same), 0.8, Tables(spark, "t")).count() == 0


def test_exact_duplicates_ignore_case_and_marks(spark):
    df = spark.createDataFrame([(2, "A b!"), (1, "a, B"), (3, "other")], "ord long, content string")
    assert {r.ord: r.first_ord for r in dedup.exact_duplicates(df, Tables(spark, "t")).collect()} == {1: 1, 2: 1, 3: 3}


def test_vocabulary(spark):
    docs = spark.createDataFrame([("Unhappy unhappy; ab 123 (cat) unhappy.",)], "text string")
    counts = vocabulary.word_counts(docs)
    assert {r.word: r.frequency for r in counts.collect()} == {"unhappy": 3, "cat": 1}
    vocab = spark.createDataFrame([("un", 0), ("happy", 1), ("cat", 2)], "token string, id int")
    (c,) = vocabulary.candidates(counts, vocab.select("token"), 1).collect()
    assert (c.word, c.frequency, c.split_count, c.base_tokens) == ("unhappy", 3, 2, ["un", "happy"])
    assert {r.token: r.id for r in vocabulary.grown(vocab, counts).collect()} == {"un": 0, "happy": 1, "cat": 2, "unhappy": 3}
    assert {r.token for r in vocabulary.manual_tokens(spark, vocab, ["cat", "gpu"]).where("present").collect()} == {"cat"}


def test_token_statistics(spark):
    df = spark.createDataFrame([("one two",), ("a b c 1234",), ("",)], "text string")
    s = tokens.corpus_stats(tokens.token_counts(df)).first()
    assert (s.num_documents, s.total_tokens, s.median_tokens, s.std_tokens) == (2, 7, 3.5, 1.5)
    assert [r.value for r in tokens.percentiles(tokens.token_counts(df), [10, 50]).collect()] == pytest.approx([2.3, 3.5])
    assert spark.range(1).select(tokens.fixed_length(F.array(F.lit(1), F.lit(2)), 3)).first()[0] == [1, 2, 0]


def test_embeddings(spark):
    base = spark.createDataFrame([(0, [1.0, 3.0]), (1, [3.0, 5.0])], "id long, embedding array<double>")
    new = spark.createDataFrame([("a", [0, 1]), ("b", [])], "token string, piece_ids array<long>")
    got = {r.token: r for r in embeddings.initialise(new, base, 2).collect()}
    assert got["a"].embedding == [2.0, 4.0] and got["a"].initialised and not got["b"].initialised
    assert embeddings.verify(embeddings.zero_rows(new, 2)).where("is_zero").count() == 2
    ids = spark.createDataFrame([(0,), (7,)], "id long")
    assert {r.id: r.embedding for r in embeddings.resized(base, ids).collect()}[7] == [2.0, 4.0]


@pytest.mark.parametrize("n", [1, 9, 10, 31])
def test_split_sizes(spark, n):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(n)] + [(99, " ")], "ord long, text string")
    got = {r.split: r["count"] for r in training.split_rows(df).groupBy("split").count().collect()}
    assert got.get("train", 0) == int(n * 0.9) and sum(got.values()) == n


def test_monitors(spark):
    losses = [5.0, 10.0, 10.01, 16.0, 4.0] + [4.0] * 8
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(losses)], "k string, s int, l double")
    rows = training.loss_monitor(df, "k", "s", "l").orderBy("s").collect()
    assert [r.is_spike for r in rows[:4]] == [False, False, True, True] and [r.is_explosion for r in rows[:4]] == [False, False, False, True]
    assert training.early_stopping(df, "k", "s", "l").first().stop_step == 12


def test_verdicts(spark):
    df = spark.createDataFrame([("base", 1, 20.0), ("same", 1, 20.0), ("five", 1, 21.0), ("worse", 1, 21.002), ("good", 1, 10.0)], "model string, n int, avg_loss double")
    assert {r.model: r.verdict for r in evaluation.verdicts(df, "base").collect()} == {"same": "marginal", "five": "marginal", "worse": "degraded", "good": "improved"}
    m = evaluation.model_rows(spark.createDataFrame([("x",)], "model string"), evaluation.loss_summary(df, "model", "avg_loss")).first()
    assert not m.exists and m.avg_loss == float("inf")


def _extracted(ord_, pages, tables=None):
    return (ord_, f"f/{ord_}.pdf", {k: (t,) for k, t in pages.items()}, tables or [], 0, len(pages))


def test_curation_end_to_end(spark):
    rng = random.Random(5)
    body = lambda: ". ".join(" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}x" for _ in range(12)) for _ in range(8))
    a, b = body(), body()
    docs = [_extracted(0, {"10": "tenth page text", "2": a}), _extracted(1, {"0": a.upper() + "\n\n tenth page text!"}), _extracted(2, {"0": b}), _extracted(3, {"0": "few words"}), _extracted(4, {"0": b.replace("x", "y", 1)})]
    schema = "ord long, file_path string, pages map<string, struct<text: string>>, tables array<struct<data: array<array<string>>>>, images_detected int, total_pages int"
    c = curation.curate(spark.createDataFrame(docs, schema))
    kept = {r.ord for r in c.curated.collect()}
    assert kept == {0, 2} and {r.ord for r in c.rejections.collect()} == {1, 3, 4}
    assert sorted(r.type for r in c.pairs.collect()) == ["exact", "fuzzy"]
    assert [r.training_rank for r in c.curated.orderBy("training_rank").collect()] == [1, 2]
    assert curation.retention(c.stages).where("stage = 'fuzzy'").first().retention == pytest.approx(0.4)
    assert curation.metadata(c).first().total_documents == 2


def test_pages_are_in_numeric_order_and_tables_numbered(spark):
    df = spark.createDataFrame([_extracted(0, {"10": "tenth page text", "2": "second page text", "0": "short"}, [([[" a ", None], ["", ""]],), (None,), ([["b", "c"]],)])],
        "ord long, file_path string, pages map<string, struct<text: string>>, tables array<struct<data: array<array<string>>>>, images_detected int, total_pages int")
    row = df.select(curation.page_text(F.col("pages")).alias("p"), curation.table_text(F.col("tables")).alias("t")).first()
    assert row.p == "second page text\n\ntenth page text" and row.t == "[TABLE_1]\na\n\n[TABLE_3]\nb | c"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"file_path": "a", "extraction_success": True, "pages": {"0": {"text": "x"}}}))
    (tmp_path / "b.json").write_text(json.dumps({"file_path": "b", "extraction_success": False, "pages": {"0": {"text": "x"}}}))
    (tmp_path / "c.json").write_text("{broken")
    assert [r.file_path for r in readers.extracted_json(spark, str(tmp_path)).collect()] == ["a"]
    (tmp_path / "l.jsonl").write_text('{"text": "a"}\n{"text": "", "content": "b"}\nbroken\n{"text": ""}\n')
    assert sorted(r.text for r in readers.json_lines(spark, str(tmp_path / "l.jsonl")).collect()) == ["a", "b"]
    (tmp_path / "t.txt").write_text("plain")
    (tmp_path / "h.html").write_text("<p>page</p>")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    got = {r.extraction_method: r for r in readers.document_files(spark, str(tmp_path)).collect()}
    assert got["text"].pages["0"].text == "plain" and got["html"].pages["0"].text == "page" and not got["failed"].extraction_success
    df = spark.createDataFrame([(2, "b"), (1, "a")], "training_rank int, text string")
    writers.training_lines(df, str(tmp_path / "out"), compressed=True)
    assert {r.text for r in spark.read.json(str(tmp_path / "out")).collect()} == {"a", "b"}


def test_incremental_stream(spark, tmp_path):
    from textloom.streaming import incremental

    words = ". ".join(" ".join(f"w{i}{j}" for j in range(10)) for i in range(8))
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"file_path": f"{k}", "extraction_success": True, "pages": {"0": {"text": words}}}))
    stream = incremental.curated_stream(incremental.extracted_stream(spark, str(tmp_path)))
    q = stream.writeStream.format("memory").queryName("curated_stream").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("curated_stream").count() == 1


def test_reports(spark, tmp_path):
    from textloom.operators import reports

    pairs = spark.range(10)
    assert reports.shown_pairs(pairs).count() == 10 and reports.shown_pairs(spark.range(11)).count() == 0
    lines = [(1, 0.0, y, 9.0, y) for y in (0.0, 5.0, 9.0)] + [(1, x, 0.0, x, 9.0) for x in (0.0, 5.0, 9.0)] + [(2, 0.0, 0.0, 9.0, 0.0)]
    (g,) = reports.grid_box(spark.createDataFrame(lines, "k int, x0 double, y0 double, x1 double, y1 double"), "k").collect()
    assert (g.k, g.bbox, g.data) == (1, [0.0, 0.0, 9.0, 9.0], [["Grid table detected"]])
    schema = "doc_id int, page int, rows int, cols int, place int, strategy int"
    found, known = spark.createDataFrame([(1, 1, 2, 2, 0, 1), (1, 1, 3, 3, 1, 1), (1, 1, 4, 4, 2, 1)], schema), spark.createDataFrame([(1, 1, 2, 2, 9, 0)], schema)
    assert [(r.rows, r.place) for r in reports.new_tables(found, known).collect()] == [(3, 1)]
    rows = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id int, embedding array<double>")
    assert not reports.pretrain_check(rows, 2, 2).first().rows_ok and reports.pretrain_check(rows.where("id = 1"), 2, 3).first().asDict() == {"rows_ok": True, "sizes_ok": False}
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "f").write_text("abc")
    assert reports.missing_files(str(tmp_path), ["out", "x"]) == ["x"] and reports.folder_bytes(str(tmp_path)) == 3
    place = reports.clean_run(str(tmp_path), ["out"])
    assert not (tmp_path / "out").exists() and (tmp_path / place / "out" / "f").read_text() == "abc"


def test_numbers_follow_the_order_across_partitions(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "ord long, score int").repartition(7)
    got = Tables(spark, "t").numbered(df, [F.desc("score"), F.col("ord")], "k").collect()
    assert [(r.score, r.ord) for r in sorted(got, key=lambda r: r.k)] == sorted(((i % 3, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert sorted(r.k for r in got) == list(range(500))


def test_new_rows_do_not_depend_on_the_layout(spark):
    tokens = spark.createDataFrame([(f"t{i}", []) for i in range(200)], "token string, piece_ids array<long>")
    base = spark.createDataFrame([(0, [1.0] * 8)], "id long, embedding array<float>")
    one, two = ({r.token: r.embedding for r in embeddings.initialise(tokens.repartition(n), base, 8).collect()} for n in (1, 5))
    flat = [x for e in one.values() for x in e]
    assert one == two and abs(sum(flat) / len(flat)) < 0.003 and abs((sum(x * x for x in flat) / len(flat)) ** 0.5 - 0.02) < 0.002
    assert {tuple(r.embedding) for r in embeddings.initialise(tokens, base, 8, fallback="mean").collect()} == {(1.0,) * 8}


def test_files_of_a_reason_come_in_parts(spark):
    rows = spark.createDataFrame([(f"f{i:03}", "a") for i in range(250)] + [("x", "b")], "filename string, reason string")
    got = reports.reason_files(rows, 100).collect()
    assert sorted(f for r in got if r.reason == "a" for f in r.files) == [f"f{i:03}" for i in range(250)] and all(r.files == sorted(r.files) for r in got)
    assert sum(r.reason == "a" for r in got) == 3 and [r.files for r in got if r.reason == "b"] == [["x"]]


def test_comparison_and_its_text(spark):
    s = spark.createDataFrame([("base", 3, 2.0, 7.0), ("pretrained", 3, 1.0, 3.0)], "model string, n long, avg_loss double, perplexity double")
    rows = evaluation.comparison(s).orderBy("place").collect()
    assert [(r.model, r.exists, r.improvement_pct) for r in rows] == [("base", True, 0.0), ("initialized", False, None), ("pretrained", True, 50.0)]
    text = evaluation.report_text(rows)
    assert "initialized: not evaluated" in text and "pretrained: loss 1.0000, perplexity 3.00, +50.00 % against base" in text
    assert evaluation.is_model_id("org/model") and not evaluation.is_model_id("/") and not evaluation.is_model_id("model")
    info = evaluation.model_info(spark.createDataFrame([("m", "p/q", True)], "model string, path string, enabled boolean")).first()
    assert info.info == "m (enabled): p/q"


def test_logger_and_stages(tmp_path, capsys):
    from textloom.logs import Stages, logger

    log = logger("textloom.test", str(tmp_path / "logs" / "run.log"))
    assert logger("textloom.test", str(tmp_path / "logs" / "run.log")).handlers == log.handlers and len(log.handlers) == 2
    stages = Stages(log)
    with stages.stage("a"):
        pass
    with stages.stage("a"):
        pass
    assert list(stages.seconds) == ["a"] and stages.total >= 0 and "a: 0.00 s" in (tmp_path / "logs" / "run.log").read_text()


def test_curation_leaves_its_files(spark, tmp_path):
    words = "It is a sentence of several words about table {}. "
    rows = [(i, f"a/{i}.json", {"0": (words.format(i) * 8,)}, [], 0, 1) for i in range(3)] + [(3, "a/3.json", {"x": ("text",)}, [], 0, 1), (4, "a/4.json", {"0": ("short text only",)}, [], 0, 1)]
    schema = "ord long, file_path string, pages map<string, struct<text: string>>, tables array<struct<data: array<array<string>>>>, images_detected int, total_pages int"
    c = curation.curate(spark.createDataFrame(rows, schema))
    writers.curation_files(c, str(tmp_path / "out"), {"all": 1.5})
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert report["input_documents"] == 5 and report["seconds"] == {"all": 1.5} and report["stage_retention"]["prepared"] == 0.6 and "fuzzy_dedup" in report["methodology"]
    statistics = json.loads((tmp_path / "out" / "statistics.json").read_text())
    assert statistics["rejections_by_stage"]["Stage 1 - Preparation"] == 2 and statistics["rejections_by_reason"] == report["rejections_by_reason"]
    files = {r.reason: list(r.files) for r in spark.read.json(str(tmp_path / "out" / "files_by_reason")).collect()}
    assert files["Processing error: page key is no number: x"] == ["3.json"] and files["No extractable content"] == ["4.json"]
    assert spark.read.json(str(tmp_path / "out" / "training")).count() == report["final_documents"] == spark.read.parquet(str(tmp_path / "out" / "dataset" / "documents")).count()


def test_page_parser_and_enrichers(spark, tmp_path):
    grid = lambda r, c: [[f"{i}{j}" for j in range(c)] for i in range(r)]
    good = {"pages": ["  First page \x00\n\n text ", "second"], "tables": [{"page": 1, "data": grid(2, 2)}, {"page": 1, "data": [["alone"]]}],
            "images": [{"page": 2, "xref": 7, "width": 100, "height": 50}, {"page": 2, "xref": 8, "width": 102, "height": 52}, {"page": 1, "xref": 9, "width": 5, "height": 5}]}
    for name, content in (("a.pdf", json.dumps(good)), ("b.pdf", "broken"), ("c.pdf", json.dumps({"pages": []})), ("d.txt", "no")):
        (tmp_path / name).write_text(content)

    def more(data, found):
        return [{"page": 1, "data": grid(2, 2)}, {"page": 1, "data": grid(3, 2)}, {"page": 1, "data": grid(4, 2)}, {"page": 2, "data": grid(2, 2)}] if found["pages"] else []

    def again(data, found):
        return [{"page": 1, "data": grid(3, 2)}, {"page": 1, "data": grid(5, 2)}]

    rows = {r.file_path.rsplit("/", 1)[1]: r for r in readers.pdf_files(spark, str(tmp_path), page_parser=json.loads, enrichers=(more, again)).collect()}
    a = rows["a.pdf"]
    assert set(rows) == {"a.pdf", "b.pdf", "c.pdf"} and not rows["b.pdf"].extraction_success and rows["c.pdf"].error == "no pages"
    assert a.pages["0"].text == "First page\ntext" and (a.pages["0"].word_count, a.pages["0"].table_count, a.pages["1"].image_count) == (3, 3, 1)
    assert [(t.page, t.rows, t.cols, t.confidence, t.method) for t in a.tables] == [(1, 2, 2, "high", "pdf"), (1, 3, 2, "medium", "pdf_enricher_1"), (2, 2, 2, "medium", "pdf_enricher_1"), (1, 5, 2, "medium", "pdf_enricher_2")]
    assert [(i.xref, i.width) for i in a.images] == [(7, 100)] and a.images_detected == 1 and a.total_pages == 2
    assert a.document_stats.asDict() == {"total_words": 4, "total_tables": 4, "total_images": 1, "total_pages": 2}
    assert curation.prepare(readers.pdf_files(spark, str(tmp_path), page_parser=json.loads).withColumn("ord", F.lit(1)).where("extraction_success"), curation.CurationConfig()).count() == 1


def test_similar_vectors_in_tiles_are_all_pairs(spark, monkeypatch):
    """Vectors of few terms, many of them alike, in blocks of about three documents: each pair once, with its whole cosine."""
    monkeypatch.setattr(tfidf, "TILE", 3)
    rng = random.Random(5)
    vectors = {}
    for n in range(60):
        v = {t: rng.choice([1.0, 2.0, 5.0]) for t in rng.sample("abcdefgh", rng.choice([1, 1, 2, 3, 4]))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors[n] = {t: x / norm for t, x in v.items()}
    df = {t: sum(t in v for v in vectors.values()) for t in "abcdefgh"}
    rows = [(n, t, df[t], x) for n, v in vectors.items() for t, x in v.items()]
    want = {(a, b): sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items()) for a, b in itertools.combinations(vectors, 2)}
    want = {p: c for p, c in want.items() if c >= 0.77}
    got = tfidf.similar_vectors(spark.createDataFrame(rows, "ord long, term string, df long, w double"), 0.77, Tables(spark, "tiles")).collect()
    assert len(got) == len(want) > 100
    assert {(r.i, r.j): r.similarity for r in got} == pytest.approx(want)


def test_tile_of_thousands_of_vectors_is_compared_by_blocks():
    """Two thousand vectors of one term are two million pairs: without a loop over pairs they take a second or so."""
    import time

    n, start = 2000, time.process_time()
    rows = pd.DataFrame({"at": 7, "x": 0, "y": 0, "b": 0, "ord": range(n), "k": [[7, 9]] * n, "w": [[0.6, 0.8]] * n})
    assert len(tfidf._tile(rows, 0.8)) == n * (n - 1) // 2
    assert time.process_time() - start < 60


def test_sets_and_terms_are_not_shuffled_again(spark, tmp_path):
    """Whole sets went by shuffle to find equal ones, and terms by document to count them."""
    df = spark.createDataFrame([(1, "alpha beta gamma alpha beta"), (2, "alpha beta delta"), (3, ""), (4, "alpha beta gamma alpha beta")], "ord long, content string")
    v = tfidf.vocabulary(tfidf.ngrams(df), 100, 3)
    assert [tuple(r) for r in v.collect()] == [("alpha beta", 3, 5), ("alpha beta gamma", 2, 2), ("beta gamma", 2, 2)]
    assert v._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    sets = spark.createDataFrame([(1, [3, 1, 2], 3), (2, [1, 2, 3], 3), (3, [1, 2], 2), (4, [12, 3], 2), (5, [1, 23], 2)], "ord long, shingles array<long>, n int")
    tables = Tables(spark, "equal")
    assert {(r.ord, r.first_ord) for r in dedup.equal_sets(sets, tables).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    assert spark.read.parquet(f"{tables.root}/set-keys").dtypes == [("ord", "bigint"), ("s", "string")]


def test_components_are_replayed_in_a_stream_and_edges_become_stars(spark):
    """Components went as whole groups to a function, and a chain took as many rounds as doublings of its length."""
    rng = random.Random(11)
    pairs = pd.DataFrame(sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(260)}), columns=["i", "j"])
    pairs["similarity"] = 1.0
    score = [rng.choice([0.3, 0.4, 0.5]) for _ in range(300)]
    pairs["q_i"], pairs["q_j"] = [score[i] for i in pairs["i"]], [score[j] for j in pairs["j"]]
    parts = list(dedup._replayed(iter([pairs[k : k + 7] for k in range(0, len(pairs), 7)])))
    want = sequential(300, {(p.i, p.j) for p in pairs.itertuples()}, score)
    assert {r for p in parts for r in p["removed"]} == want
    stars = pd.concat(dedup._stars(iter([pairs[:100], pairs[100:]]), 50))
    assert len(stars) < len(pairs)
    scores = spark.createDataFrame(list(enumerate(score)), "ord long, score double")
    got = dedup.greedy_removals(spark.createDataFrame(pairs[["i", "j", "similarity"]]).repartition(3), scores, Tables(spark, "stream"), "x")
    assert {r.removed for r in got.collect()} == want and "MapInPandas" in got._jdf.queryExecution().optimizedPlan().toString()
    chain = spark.range(1000).selectExpr("id i", "id + 1 j").coalesce(1)
    tables = Tables(spark, "chain")
    assert {r.label for r in dedup.component_labels(chain, tables, "c").collect()} == {0}
    assert spark.read.parquet(f"{tables.root}/c-1").count() == 1001 and not os.path.exists(f"{tables.root}/c-3".replace("file://", ""))


def test_terms_are_counted_in_parts_with_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "HELD", 3)
    rows = [(1, "Alpha beta the GAMMA alpha beta x"), (2, None), (3, "alpha_1 Été ٣٤ de-ta"), (4, ""), (5, "beta gamma")]
    df = spark.createDataFrame(rows, "ord long, content string").coalesce(1)
    got = {r.term: (r.df, r.cf) for r in tfidf.vocabulary(tfidf.ngrams(df), 100).collect()}
    assert got == {"alpha beta": (1, 2), "beta gamma": (2, 2), "gamma alpha": (1, 1), "alpha beta gamma": (1, 1), "beta gamma alpha": (1, 1), "gamma alpha beta": (1, 1),
                   "alpha_1 été": (1, 1), "été ٣٤": (1, 1), "٣٤ de": (1, 1), "de ta": (1, 1), "alpha_1 été ٣٤": (1, 1),
                   "été ٣٤ de": (1, 1), "٣٤ de ta": (1, 1)}
    assert {(r.ord, r.term, r.df, r.tf) for r in tfidf.term_counts(df, {"alpha beta": 1, "beta gamma": 2}).collect()} == {(1, "alpha beta", 1, 2), (1, "beta gamma", 2, 1), (5, "beta gamma", 2, 1)}


def test_curation_writes_texts_once_and_ranks_on_demand(spark):
    """Pages and the words of each text were written with it, and counts of rejections had all rows redacted and ranked."""
    docs = [_extracted(k, {"0": f"It is sentence {k} of a table in the study. " * (9 + k)}) for k in range(3)]
    schema = "ord long, file_path string, pages map<string, struct<text: string>>, tables array<struct<data: array<array<string>>>>, images_detected int, total_pages int"
    c = curation.curate(spark.createDataFrame(docs, schema), until="exact")
    root = c.tables.root.replace("file://", "")
    assert not {"pages", "words", "tokens", "lower_words"} & set(spark.read.parquet(f"{c.tables.root}/prepared").columns)
    c.rejections.collect(), curation.metadata(c).collect()
    assert not any("ranks" in f for f in os.listdir(root))
    assert c.curated.count() == 3 and any("ranks" in f for f in os.listdir(root))


def test_files_of_known_names_are_not_listed(spark, tmp_path):
    """Spark listed a file a document and sent the list to the driver; more names than are read at once, odd characters in them."""
    from textloom.plans import registry

    rows = [(k, f"text {k}\nünï \"q\"" if k else None, "a b" if k % 2 else None) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["document_files_read_back"](spark, str(tmp_path))
    assert "JsonScan" not in (plan := df._jdf.queryExecution().toString()) and "MapInPandas" in plan and " json" not in plan.lower().split("== physical plan ==")[1].split("mapinpandas")[0]
    want = {(f"{k}.pdf", hashlib.md5((t or "").encode()).hexdigest()) for k, t, _ in rows}
    assert {tuple(r) for r in df.collect()} == want


def test_words_of_a_document_are_counted_where_they_are_made(spark, tmp_path):
    from textloom.plans import registry

    rows = [(1, "One one TWO ΟΔΟΣ İx"), (1, "one more"), (2, None), (3, " \n ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["doc_word_frequency"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {(1, "one", 3), (1, "two", 1), (1, "οδος", 1), (1, "i̇x", 1), (1, "more", 1)}
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    assert "word" not in df._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")[-1].split("\n")[0]


def test_rare_terms_are_neither_shuffled_nor_missed(spark, tmp_path, monkeypatch):
    rng = random.Random(48)
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(40)] + [f"c{rng.randint(0, 3)} d{rng.randint(0, 3)} e{i % 2}" for _ in range(6)])) for i in range(120)]
    df = spark.createDataFrame([*rows, (200, None), (201, "")], "ord long, content string")
    asked, ngrams = [], tfidf.ngrams

    def counted(*args, **named):
        out = ngrams(*args, **named)
        asked.append(out.agg(F.countDistinct("term")).first()[0])
        return out

    every = {(r.term, r.df, r.cf) for r in tfidf.vocabulary(ngrams(df), 122, 20).collect()}
    monkeypatch.setattr(tfidf, "ngrams", counted)
    assert {(r.term, r.df, r.cf) for r in tfidf.listed_terms(df, 122, "content", 20, 0.95, Tables(spark, "terms")).collect()} == every
    assert len(asked) == 1 and asked[0] < 500 and ngrams(df).count() > 9000
    most = {(r.term, r.df, r.cf) for r in tfidf.listed_terms(df, 122, "content", 50_000, 0.95, Tables(spark, "terms")).collect()}
    assert most == {(r.term, r.df, r.cf) for r in tfidf.vocabulary(ngrams(df), 122, 50_000).collect()} and len(most) > 9000
