"""Operators 3, 6, 8, 9, 10 and the pipeline against brute-force versions; nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import line_templates, lm_scoring, near_duplicates, quality_rules, repeats, suffix_array
from textloom.llm.components import connected_components
from textloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_id string, label int, n long"


def table(spark, path, rows):
    """rows: (doc_id, text, source); further columns have names that the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 1, 2) for i, t, s in rows]
    spark.createDataFrame(full, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{chr(97 + x // 20)}{chr(97 + x % 20)}q" for x in (rng.randint(0, vocabulary) for _ in range(n)))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    foot = "Follow this site on the usual channels today"
    shared = prose(rng, 40)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(8, 25)) for _ in range(rng.randint(3, 8))]
        if i % 2:
            lines.append(foot)
        if i % 5 == 0:
            lines.insert(1, shared)
        rows.append((i, "\n".join(lines), f"host{i % 2}"))
    base = rows[0][1].split(" ")
    for k in range(12):  # near and exact copies
        w = list(base)
        if k % 3:
            w[k * 3 % len(w)] = f"edit{k}"
        rows.append((100 + k, " ".join(w), "host0"))
    rows += [(200, None, None), (201, "", "host1"), (202, "one two three", "host0"), (203, "x" * 700 + " " + "ab " * 300, "host1"), (None, prose(rng, 60), "host0")]
    return rows


def test_quality_text_rules():
    for seed in range(50):
        rng = random.Random(seed)
        text = "".join(rng.choice(["a ", "b ", "c ", "\n", "# ", "é", "\x0b", "a b c "]) for _ in range(rng.randint(0, 60)))
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert quality_rules.text_rules(text) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


def test_quality_rules(spark, tmp_path):
    rng = random.Random(3)
    foot = "Share this page 2024 with all of your friends and colleagues now please do"
    rows = [(i, "\n".join([foot] * 4 + [prose(rng, 5)]) + "\n" + foot.replace("2024", "7"), "h") for i in range(30)]  # depleted by a footer
    rows += [(100 + i, prose(rng, 70) + "\n" + foot, "h") for i in range(10)]  # the footer is a small part
    copy = prose(rng, 80) + "\n" + prose(rng, 30)
    rows += [(200 + i, copy, "h") for i in range(40)] + [(300, copy, "h"), (300, copy, "h"), (400, None, None), (401, "", "h")]
    got = {r.doc_id: r for r in quality_rules.op10_quality_rules(spark, table(spark, tmp_path, rows)).collect()}
    assert not any(got[i].kept for i in range(30)) and not any(got[i].base_failed and got[i].n_words >= 50 and not got[i].n_repeat_words for i in range(30))
    assert all(got[i].kept for i in (*range(100, 110), *range(200, 240), 300)) and got[100].n_removed_words == 14
    assert got[400].base_failed and not got[401].kept
    kept = quality_rules.apply_quality_rules(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and kept.where("doc_id = 300").count() == 2


def test_lines_above_the_limit_are_removed(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    rows = [(i, f"{prose(rng, 60)}\nShare page {i} now\n\n{prose(rng, 30)}", "h") for i in range(30)]
    rows += [(100, f"{prose(rng, 60)}\nShare page 5 now", "other"), (101, prose(rng, 60), None)]
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    expected = {i: t.replace(f"\nShare page {i} now", "") for i, t, _ in rows}
    assert {i: r.text for i, r in out.items()} == expected and all(r.n_chars == len(r.text) and r.k_id == "x" for r in out.values())


def test_line_templates(spark, tmp_path):
    rng = random.Random(4)
    names = [f"name{chr(97 + i)}" for i in range(15)]
    rows = [(i, f"{prose(rng, 9)}\nThe session of user {names[i]} ended after {i} seconds\n{prose(rng, 9)}", "h") for i in range(15)]
    copy = "\n".join(prose(rng, 9) for _ in range(3))
    rows += [(100 + i, copy, "h") for i in range(20)] + [(200, None, None), (201, "", "h"), (15, rows[0][1], "h")]
    d = table(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert {r.k_id: list(r.dropped) for r in line_templates.recurring_lines(docs).collect()} == {i: [1] for i in range(16)}
    out = {r.doc_id: r for r in line_templates.dedup_lines(docs).collect()}
    assert out[3].text == "\n".join(rows[3][1].split("\n")[::2]) and out[100].text == copy and out[200].text is None
    assert line_templates.op6_line_dedup(spark, d).count() == len(rows)


def test_a_block_of_shared_lines_is_dropped(spark, tmp_path):
    rng = random.Random(13)
    block = [prose(rng, 9) for _ in range(8)]
    rows = [(i, "\n".join([*block[:4], *(prose(rng, 30) for _ in range(3)), *block[4:]]), "h") for i in range(30)]
    words = prose(rng, 150).split(" ")
    for i in range(20):  # near copies, one word apart
        w = [*words[: 7 * i], f"edit{i}", *words[7 * i + 1 :]]
        rows.append((100 + i, "\n".join(" ".join(w[k : k + 30]) for k in range(0, 150, 30)), "h"))
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    got = {r.k_id: sorted(r.dropped) for r in line_templates.recurring_lines(docs, copies="near").collect()}
    assert got == {i: [0, 1, 2, 3, 7, 8, 9, 10] for i in range(30)}
    every = {r.k_id: sorted(r.dropped) for r in line_templates.recurring_lines(docs).collect()}
    assert {i: every[i] for i in range(30)} == got and len(every) == 50


def boilerplate(shared, seed, hosts=4, pages=30):
    """Pages of three lines of their own and some that their host's pages share."""
    rng = random.Random(seed)
    rows = []
    for h in range(hosts):
        common = [prose(rng, 12) for _ in range(shared)]
        for i in range(pages):
            lines = [prose(rng, 12) for _ in range(3)]
            for c in common:
                lines.insert(rng.randint(0, len(lines)), c)
            rows.append((1000 * h + i, "\n".join(lines), f"host{h}"))
    return rows


@pytest.mark.parametrize("shared", [1, 2, 5, 10])
def test_shared_lines_are_found_however_many_a_page_has(spark, tmp_path, shared):
    rows = [r for seed in (1, 2) for r in [(i + 100_000 * seed, t, f"{s}-{seed}") for i, t, s in boilerplate(shared, seed)]]
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    held = Counter((s, x) for _, t, s in rows for x in set(t.split("\n")))
    common = {x for (_, x), n in held.items() if n > 20}
    for copies in ("text", "near") if shared in (2, 10) else ("text",):
        got = {r.k_id: sorted(r.dropped) for r in line_templates.recurring_lines(docs, copies=copies).collect()}
        assert got == {i: [k for k, x in enumerate(t.split("\n")) if x in common] for i, t, _ in rows}
        verdicts = {r.doc_id: r for r in quality_rules.judge(docs, copies=copies).collect()}
        assert all(verdicts[i].n_removed_words == 12 * shared and verdicts[i].kept == (len(t.split()) >= 50 and shared < 10) for i, t, _ in rows)


def test_near_copies_keep_their_lines(spark, tmp_path):
    rng = random.Random(17)
    words = prose(rng, 200).split(" ")
    rows = []
    for i in range(40):  # lines of 20 words; two or three words of each copy differ
        w = list(words)
        for _ in range(3):
            w[rng.randrange(200)] = f"edit{chr(97 + i % 26)}{chr(97 + i // 26)}"
        rows.append((i, "\n".join(" ".join(w[k : k + 20]) for k in range(0, 200, 20)), "h"))
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    assert line_templates.recurring_lines(docs, copies="near").count() == 0 and line_templates.recurring_lines(docs).count() == 40
    assert {r.n_removed_words for r in quality_rules.judge(docs, copies="near").collect()} == {0}
    assert all(r.n_removed_words > 60 for r in quality_rules.judge(docs).collect())


def brute_templates(rows, depth=3, min_tokens=4, min_docs=10, max_children=4, min_constant=0.6):
    """Line numbers that go, by document, from dictionaries of tokens."""
    leaves, holders, lines = defaultdict(lambda: defaultdict(set)), defaultdict(set), []
    for i, t, _ in rows:
        for no, line in enumerate((t or "").split("\n")):
            tokens = line.split()
            masked = tuple("<*>" if re.search("[0-9]", x) else x for x in tokens)
            leaf = (len(masked), *masked[:depth]) if len(tokens) >= min_tokens else ("exact", *tokens)
            if tokens:
                lines.append((i, t, no, leaf, masked if len(tokens) >= min_tokens else leaf))
                holders[leaf].add((i, t))
                for k, x in enumerate(masked if len(tokens) >= min_tokens else ()):
                    if x != "<*>":
                        leaves[leaf][k].add(x)
    named = []
    for i, t, no, leaf, own in lines:
        variable = {k for k, xs in leaves[leaf].items() if len(xs) > max_children} if len(holders[leaf]) >= min_docs else set()
        general = tuple("<*>" if k in variable else x for k, x in enumerate(own))
        constant = sum(x != "<*>" for x in general)
        named.append((i, t, no, (leaf, general) if variable and constant >= min_constant * len(own) else (leaf, own)))
    docs = defaultdict(set)
    for i, t, _, template in named:
        docs[template].add(t)
    out = defaultdict(set)
    for i, _, no, template in named:
        if len(docs[template]) >= min_docs:
            out[i].add(no)
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_templates_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    forms = ["Posted by {} on day {} of the month in {}", "Read more", "Page {} of {}", "The {} of {} was {} when {} came to {}", "首页 导航 é {}", "All rights reserved {} by {} and {}"]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 8)):
            form = rng.choice(forms) if rng.random() < 0.6 else prose(rng, rng.randint(1, 9), 6)
            lines.append(re.sub(r"\{\}", lambda _: rng.choice([f"n{rng.randint(0, 9)}", rng.choice("abc"), rng.choice("abcdefghij")]), form))
        rows.append((i, "\n".join(rng.choice(["", " ", "\t"]) + x for x in lines), "h"))
    rows += [(200, None, None), (201, "", "h"), (202, "\n\n \n", "h"), (203, "long line " * 40_000, "h"), (150, rows[3][1], "h"), (3, rows[3][1], "h")]
    d = table(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    expected = brute_templates(rows)
    assert len(expected) > 50
    assert {r.k_id: sorted(r.dropped) for r in line_templates.recurring_lines(docs).collect()} == expected
    kept = {i: "\n".join(x for no, x in enumerate((t or "").split("\n")) if no not in expected.get(i, ())) for i, t, _ in rows}
    got = line_templates.op6_line_dedup(spark, d).collect()
    assert sorted((r.doc_id, r.n_dropped_lines, r.kept_bytes, r.kept_sha256) for r in got) == sorted(
        (i, len(expected.get(i, ())), len(kept[i].encode()), hashlib.sha256(kept[i].encode()).hexdigest()) for i, _, _ in rows
    )


def test_short_lines_are_dropped_by_their_exact_tokens(spark, tmp_path):
    rng = random.Random(14)
    rows = [(i, "\n".join(["All rights reserved.", prose(rng, 40), f"Page {i}", "首页导航栏", "", str(i)]), "h") for i in range(12)]
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    got = {r.k_id: sorted(r.dropped) for r in line_templates.recurring_lines(docs).collect()}
    assert got == {i: [0, 3] for i in range(12)}


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def similar_classes(rows):
    """Classes of texts by the longest common subsequence of their words, all pairs compared."""
    words, parent = [(t or "").lower().split() for _, t, _ in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = words[a], words[b]
        bag = sum((Counter(x) & Counter(y)).values())
        if x and y and bag >= 0.8 * (len(x) + len(y) - bag) and (m := common_words(x, y)) >= 0.8 * (len(x) + len(y) - m):
            parent[root(b)] = root(a)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(rows[i][0])
    return sorted(sorted((x if x is not None else -1) for x in c) for c in classes.values())


def test_near_duplicates(spark, tmp_path):
    rng = random.Random(6)
    rows = corpus()
    seed = prose(rng, 120).split(" ")
    for k in range(25):  # copies of different closeness, in a chain and apart
        w = list(seed)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((500 + k, " ".join(w), "h"))
    rows.append((700, rows[-1][1], "h"))
    got = near_duplicates.op8_near_duplicates(spark, table(spark, tmp_path, rows)).collect()
    classes = defaultdict(list)
    for k, r in enumerate(got):
        empty = r.n_links == 0 and r.class_id in (200, 201)
        classes[r.class_id, k if empty else 0].append(r.doc_id if r.doc_id is not None else -1)
    assert sorted(map(sorted, classes.values())) == similar_classes(rows)
    kept = near_duplicates.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    again = [(1, rows[0][1], "h"), (1, rows[1][1], "h"), (1, rows[1][1], "h"), (2, rows[0][1], "h")]
    same_id = near_duplicates.drop_near_duplicates(spark.read.parquet(table(spark, tmp_path / "again", again) + "/documents.parquet"))
    assert sorted(r.text for r in same_id.collect()) == sorted([rows[0][1], rows[1][1]])
    assert kept.count() == len(classes) and kept.columns[:2] == ["doc_id", "text"]


def test_order_min_hash_depends_on_order():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    same = lambda x, y: (near_duplicates.sketches_of(x) == near_duplicates.sketches_of(y)).mean()
    near = a.copy()
    near[::40] = rng.integers(0, 1 << 60, 10).astype(np.uint64)
    assert same(a, a) == 1 and same(a, near) > 0.5 and same(a, a[::-1].copy()) < 0.3


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        words = range(rng.choice([4, 30]))
        a = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        b = [x for x in a if rng.random() < 0.9] if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice(words))
        m = common_words(a, b)
        assert near_duplicates.banded_matches(a, b, 50) == m
        for t in (0.3, 0.8):
            got = near_duplicates.alike(np.array(a, np.uint64), np.array(b, np.uint64), t)
            assert got == (min(len(a), len(b)) >= t * max(len(a), len(b)) and m >= t * (len(a) + len(b) - m))


def test_very_long_texts_are_aligned_in_parts():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 3000, 50_000).astype(np.uint64)
    b = a.copy()
    b[rng.random(len(a)) < 0.1] = 5000  # 0.9 / 1.1 = 0.82
    c = a.copy()
    c[rng.random(len(a)) < 0.14] = 5000  # 0.86 / 1.14 = 0.75
    assert near_duplicates.alike(a, b) and not near_duplicates.alike(a, c) and not near_duplicates.alike(a, np.sort(a))


def edited(rng, words, share):
    return [f"e{rng.random()}" if rng.random() < share else w for w in words]


def test_recall_by_edit_rate(spark, tmp_path):
    rng = random.Random(31)
    rows, rates = [], (0.0, 0.01, 0.02, 0.03, 0.05)
    for k, rate in enumerate(rates):
        for i in range(60):
            text = prose(rng, 300, 399).split(" ")
            rows += [(10_000 * k + 2 * i, " ".join(text), "h"), (10_000 * k + 2 * i + 1, " ".join(edited(rng, text, rate)), "h")]
    got = near_duplicates.op8_near_duplicates(spark, table(spark, tmp_path, rows)).collect()
    assert all(r.class_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in got)  # nothing else is taken for a copy
    recall = [sum(r.doc_id % 2 and r.class_id == r.doc_id - 1 for r in got if r.doc_id // 10_000 == k) / 60 for k in range(len(rates))]
    assert recall[:3] == [1, 1, 1] and recall[3] >= 0.95 and recall[4] >= 0.85, recall


def test_many_small_components_share_a_passage(spark, tmp_path):
    rng = random.Random(32)
    passage = prose(rng, 120, 399).split(" ")
    rows = []
    for i in range(80):  # pairs of copies; each pair has 60 words of its own besides the passage
        own = prose(rng, 60, 399).split(" ")
        rows += [(2 * i, " ".join(passage + own), "h"), (2 * i + 1, " ".join([*passage, *own[:30], "edit", *own[31:]]), "h")]
    got = {r.doc_id: r.class_id for r in near_duplicates.op8_near_duplicates(spark, table(spark, tmp_path, rows)).collect()}
    assert sum(got[i] == i - i % 2 for i in got) >= 0.97 * len(got) and all(got[i] in (i, i - 1) for i in got)


def scattered(words, every):
    """The words, every so many of them replaced: few shingles are left, most words are."""
    return [f"s{i}x{words[0]}" if i % every == every // 2 else w for i, w in enumerate(words)]


def test_n_links_are_all_links(spark, tmp_path):
    rng = random.Random(41)
    texts = []
    for size in (40, 25, 3, 2):
        base = prose(rng, 90, 399).split(" ")
        texts += [" ".join(edited(rng, base, rng.choice((0.01, 0.03, 0.06, 0.09)))) for _ in range(size)]
    for _ in range(10):
        base = prose(rng, 110, 399).split(" ")
        texts += [" ".join(base), " ".join(scattered(base, 10))]
    texts, links = list(dict.fromkeys(texts)), Counter()
    for a, b in itertools.combinations(texts, 2):
        x, y = a.split(" "), b.split(" ")
        if (m := common_words(x, y)) >= 0.8 * (len(x) + len(y) - m):
            links.update([a, b])
    rows = [(i, t, "h") for i, t in enumerate([*texts, *texts[:5]])]
    got = near_duplicates.op8_near_duplicates(spark, table(spark, tmp_path, rows)).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: links[t] for i, t, _ in rows} and sum(links.values()) > 900


def test_texts_of_a_few_common_rare_words_are_no_candidates(spark, tmp_path, monkeypatch):
    rng = random.Random(43)
    met, save = [], Scratch.save

    def counted(self, df, label):
        out = save(self, df, label)
        met.extend([out.count()] * (label == "met"))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    rows = []
    for i in range(40):  # two rare words that five texts share, some of its own, and others that more texts hold
        words = [f"w{i}x{k}" for k in range(18)] + [f"s{i % 8}", f"t{i % 8}"] + rng.sample([f"p{k}" for k in range(900)], 180)
        rng.shuffle(words)
        rows.append((2 * i, " ".join(words), "h"))
    for i in range(0, 20, 2):
        rows.append((2 * i + 1, " ".join(scattered(rows[i][1].split(" "), 10)), "h"))
    got = near_duplicates.op8_near_duplicates(spark, table(spark, tmp_path, rows)).collect()
    copied = {2 * i for i in range(0, 20, 2)}
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i - i % 2, int(i - i % 2 in copied)) for i, *_ in rows}
    assert met == [len(copied)]


def shared_runs(texts, run=2):
    """Runs of words that two texts share, the end counted as a word."""
    of = [Counter(zip(*([*x, None][i:] for i in range(run)))) for x in texts]
    return sum((of[0] & of[1]).values())


def test_linked_texts_share_the_runs_that_the_join_asks_for():
    rng = random.Random(46)
    counts = np.random.default_rng(46).integers(0, 9, (2, near_duplicates.COUNTERS)).astype(np.int32)
    linked = 0
    for _ in range(2000):
        a = [rng.randrange(60) for _ in range(rng.randint(1, 60))]
        b = [x for x in a if rng.random() < rng.choice((0.85, 1))]
        for _ in range(rng.randint(0, 8)):
            b.insert(rng.randint(0, len(b)), rng.randrange(60, 99))
        if not b or (m := common_words(a, b)) < 0.8 * (len(a) + len(b) - m):
            continue
        linked += 1
        assert shared_runs([a, b]) >= (len(a) + len(b)) / 3 - 1e-9
        words = [np.array(x, np.uint64) + np.uint64(1) for x in (a, b)]
        x, y = (near_duplicates.rarest_runs(w, counts, 0.8).tolist() for w in words)
        assert set(x) & set(y)
    assert linked > 200


def test_texts_of_the_same_words_do_not_meet(spark, tmp_path, monkeypatch):
    """Words are held by all texts, pairs of them by few: the join's rows do not grow with the square of the texts of a word."""
    rng = random.Random(47)
    met, save = [], Scratch.save

    def counted(self, df, label):
        out = save(self, df, label)
        met.extend([out.count()] * (label == "rare-words"))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    words = [f"v{k}" for k in range(300)]
    rows = [(i, " ".join(rng.sample(words, 300)), "h") for i in range(60)]
    rows.append((60, " ".join(scattered(rows[7][1].split(" "), 10)), "h"))
    got = near_duplicates.op8_near_duplicates(spark, table(spark, tmp_path, rows)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, 7 if i == 60 else i, int(i in (7, 60))) for i, *_ in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in near_duplicates.drop_near_duplicates(docs).collect()) == list(range(60))
    assert len(met) == 2 and max(met) < 60 * 300 * 0.24 / 2, met  # by words, all of the rarest 0.24 x 300 of each text


def test_the_pipeline_finds_scattered_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(42)
    rows = []
    for i in range(30):  # every tenth word differs: sketches of five-word shingles seldom meet
        base = prose(rng, 100, 399).split(" ")
        rows += [(2 * i, " ".join(base), "h"), (2 * i + 1, " ".join(scattered(base, 10)), "h")]
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 2))


def test_a_group_of_near_copies_meets_itself_once(spark, tmp_path, monkeypatch):
    rng = random.Random(44)
    met, save = [], Scratch.save

    def counted(self, df, label):
        out = save(self, df, label)
        met.extend([out.count()] * (label == "met"))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    base = prose(rng, 120, 399).split(" ")
    rows = [(i, " ".join(edited(rng, base, rng.choice((0.01, 0.03, 0.05, 0.07)))), "h") for i in range(160)]
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    assert [r.doc_id for r in near_duplicates.drop_near_duplicates(docs).collect()] == [0]
    assert len(met) == 1 and met[0] <= len(rows)


def test_class_members_are_all_classes(spark, tmp_path):
    rng = random.Random(45)
    texts = []
    for size in (30, 4, 2):  # edits that sketches miss, or that leave a text linked to some of its group only
        base = prose(rng, 90, 399).split(" ")
        texts += [" ".join(edited(rng, base, rng.choice((0.01, 0.05, 0.09, 0.13)))) for _ in range(size)]
    for _ in range(6):  # chains: each text is linked to the next
        words = prose(rng, 100, 399).split(" ")
        for _ in range(5):
            texts.append(" ".join(words))
            words = scattered(words, 10)[7:] + prose(rng, 4, 399).split(" ")
    texts = list(dict.fromkeys(texts))
    least = list(range(len(texts)))
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        x, y = a.split(" "), b.split(" ")
        if (m := common_words(x, y)) >= 0.8 * (len(x) + len(y) - m):
            old, new = sorted((least[i], least[j]), reverse=True)
            least = [new if c == old else c for c in least]
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(900, None, "h"), (901, "", "h"), (902, texts[3], "h")]
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    got = {r.k_id: r.class_id for r in near_duplicates.class_members(docs).collect()}
    assert got == {**dict(enumerate(least)), 900: 900, 901: 901, 902: least[3]} and 5 < len(set(least)) < len(texts)


@pytest.mark.parametrize("alone", [0, 1 << 17])
def test_components_in_one_task_and_in_many(spark, alone):
    rng = random.Random(46)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges = [(a, b) for a, b in edges if a != b]
    expected = {x: x for e in edges for x in e}
    for _ in expected:
        for a, b in edges:
            expected[a] = expected[b] = min(expected[a], expected[b])
    got = connected_components(spark.createDataFrame(edges, "a int, b int"), Scratch(spark, "t"), "c", alone)
    assert {r.node: r.label for r in got.collect()} == expected
    none = connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "n", alone)
    assert none.count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (60, 61)], "a int, b int")
    labels = {r.node: r.label for r in connected_components(edges, Scratch(spark, "t"), "c").collect()}
    assert labels == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40, 60: 60, 61: 60}


def test_components_of_dense_groups(spark, monkeypatch):
    rows, save = {}, Scratch.save

    def counted(self, df, label):
        out = save(self, df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    dense = list(itertools.combinations(range(40), 2))
    hubs = [(100 + i, 200 + i % 3) for i in range(60)] + [(200, 201)]  # the greatest node has the links; two hubs meet
    paths = [(300, 310), (300, 311), (301, 310), (301, 312), (302, 311), (302, 312), (305, 306)]
    edges = spark.createDataFrame(dense + hubs + paths, "a int, b int")
    labels = {r.node: r.label for r in connected_components(edges, Scratch(spark, "t"), "c").collect()}
    expected = {i: 0 for i in range(40)} | {100 + i: 102 if i % 3 == 2 else 100 for i in range(60)} | {200: 100, 201: 100, 202: 102}
    assert labels == expected | {i: 300 for i in (300, 301, 302, 310, 311, 312)} | {305: 305, 306: 305}
    assert rows["c-edges"] <= 4 * len(labels)  # what each step joins
    rng = random.Random(9)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    least = list(range(400))
    for _ in range(400):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = connected_components(spark.createDataFrame(pairs, "a int, b int"), Scratch(spark, "t"), "c").collect()
    assert {r.node: r.label for r in got} == {x: least[x] for p in pairs for x in p}


def brute_kept(rows):
    """(id, text without repeats) in ascending order of ids."""
    out, seen = [], set()
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            g = b[s : s + 100]
            if g in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(g)
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def brute_quality(rows):
    """Documents that the quality rules keep, without the lines above the limit."""
    held = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if k := quality_rules.normalise_line(line):
                held[s or "", k].add(t)
    out = []
    for i, t, s in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        marked = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        gone = [x for x in (t or "").split("\n") if len(held[s or "", quality_rules.normalise_line(x)]) > 20]
        if len(words) >= 50 and 100 * len(marked) <= 50 * len(words) and 100 * sum(len(x.split()) for x in gone) <= 70 * len(words):
            out.append((i, "\n".join(x for x in t.split("\n") if x not in gone), s))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(41)
    passage, rows = prose(rng, 60), []
    for i in range(70):
        lines = [prose(rng, rng.randint(15, 40)) for _ in range(4)]
        if i < 30:
            lines.insert(rng.randint(0, 4), f"Page {i} of the site, all rights reserved")  # above the limit of its host
        if i % 4 == 0:
            lines.insert(2, f"Posted by user{i} on the old board")  # a template of 17 documents
        if i % 9 == 0:
            lines.append(f"{prose(rng, 5)} {passage} é {prose(rng, 5)}")
        rows.append((i, "\n".join(lines), "site" if i < 30 else f"h{i % 3}"))
    rows += [(200 + i, rows[40][1], "h1") for i in range(6)] + [(300 + i, rows[41][1].replace(" ", f" x{i} ", 1), "h2") for i in range(4)]
    rows += [(400, None, None), (401, "", "h"), (402, "too short", None), (403, "again and " * 60, "h"), (404, prose(rng, 30_000), None)]
    d = table(spark, tmp_path, rows)
    one = brute_quality(rows)
    drop = brute_templates(one)
    two = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop.get(i, ())), s) for i, t, s in one]
    least = {x[0] for x in similar_classes([r for r in two if r[0] != 404])} | {404}
    four = brute_kept([(i, t) for i, t, _ in two if i in least])
    assert len(rows) > len(one) > len(four) and any(drop.values()) and sum(len(t) for _, t in four) < sum(len(t) for i, t, _ in two if i in least)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        expected = {"quality_rules": one, "line_dedup": two, "near_duplicates": [r for r in two if r[0] in least], "suffix_dedup": four}[name]
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted((r[0], r[1]) for r in expected), name
        assert docs.where("n_chars <> length(text)").count() == 0 or name == "near_duplicates"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in four}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, d).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for i, rs in pieces.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


def brute_repeats(rows):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            g = b[s : s + 100]
            if g in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((rows[i][0], len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("split", [2048, 5])
def test_repeats(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT_CONTEXTS", split)
    monkeypatch.setattr(repeats, "SHARD_CONTEXTS", split * 4)
    rng = random.Random(9)
    piece = [prose(rng, 12) for _ in range(6)]
    rows = corpus() + [(600 + i, "".join(rng.choice(piece) + rng.choice(["", " x", "é"]) for _ in range(rng.randint(1, 6))), "h") for i in range(60)]
    d = table(spark, tmp_path, rows)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op9_suffix_dedup(spark, d).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == brute_repeats(rows)
    out = repeats.drop_repeats(spark.read.parquet(f"{d}/documents.parquet"))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and out.where("doc_id = 200 and text is null").count() == 1


def test_rows_equal_in_id_and_text_are_one_document(spark, tmp_path):
    text = prose(random.Random(1), 60)
    d = table(spark, tmp_path, [(1, text, "h"), (1, text, "h"), (2, text, "h")])
    assert sorted((r.doc_id, r.n_removed) for r in repeats.op9_suffix_dedup(spark, d).collect()) == [(1, 0), (1, 0), (2, len(text))]


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(60):
        t = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 120)))
        text = np.frombuffer(t, np.uint8)
        order = suffix_array.suffix_array(text)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        edges = np.array(sorted({0, len(t), *(rng.randrange(len(t)) for _ in range(3))}))
        lcp = suffix_array.common_prefixes(text, order, edges[:-1], edges[1:], 10)
        for k in range(1, len(t)):
            a, b = t[order[k - 1] :], t[order[k] :]
            assert lcp[k] == min(10, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 900, "range_bytes": 700}, {"min_count": 1}])
def test_language_model(spark, tmp_path, sizes):
    rows = corpus()
    rows = [(i, None if t is None else t.replace("wa", "Wa"), s) for i, t, s in rows if i is not None]
    d = table(spark, tmp_path, rows)
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)) + ["end"] for _, t, _ in rows]
    out = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows]
    c = Counter(w for x, o in zip(words, out) if not o for w in x)
    total, kinds = sum(c.values()), len(c)
    root = lambda w: (c.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))
    arcs = Counter(p for x, o in zip(words, out) if not o for p in zip(["end", *x], x))
    arcs = {p: n - lm_scoring.DISCOUNT for p, n in arcs.items() if n >= sizes.get("min_count", 2)}
    taken = Counter()
    for (a, _), n in arcs.items():
        taken[a] += n
    chance = lambda a, w: arcs.get((a, w), 0) / max(c.get(a, 0), 1) + (1 - taken[a] / max(c.get(a, 0), 1)) * root(w)
    for a in ["end", *list(c)[:20], "never met"]:  # a state's probabilities, that of any unknown word with them, add up to 1
        assert sum(chance(a, w) for w in [*c, "never met"]) == pytest.approx(1)
    got = {r.doc_id: r for r in lm_scoring.score_documents(spark.read.parquet(f"{d}/documents.parquet"), **sizes).collect()}
    for (i, _, _), x, o in zip(rows, words, out):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (o, len(x), sum(w in c for w in x), total)
        assert r.base_score == pytest.approx(sum(math.log10(root(w)) for w in x))
        assert r.score == pytest.approx(sum(math.log10(chance(a, w)) for a, w in zip(["end", *x], x)))


def test_bigrams_of_rare_words_in_a_large_corpus(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, prose(rng, 3000), "h") for i in range(50)]  # 150,000 tokens
    learnt = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    held = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows += [(i, "zeta eta", "h") for i in (*learnt, held)]
    got = {r.doc_id: r for r in lm_scoring.op3_lm_scoring(spark, table(spark, tmp_path, rows)).collect()}
    # Two arcs of 1.25 / 2, and more than 1.25 / (documents learnt from) at the start: far above what single words would give.
    assert got[held].held_out and got[held].score > 2 * math.log10(1.25 / 2) + math.log10(1.25 / 53) and got[held].base_score < -12


def test_language_model_with_a_very_long_text_repeated_rows_and_null_ids(spark, tmp_path):
    rng = random.Random(21)
    long = prose(rng, 120_000)
    rows = [(1, long, "h"), (2, "short text", "h"), (2, "short text", "h"), (None, "no id", None), (3, None, "h")]
    got = lm_scoring.score_documents(spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet"), block_bytes=10_000, range_bytes=50_000).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 120_001), (2, 3), (2, 3), (3, 1)]
    assert len({r.train_tokens for r in got}) == 1 and len({r.score for r in got if r.doc_id == 2}) == 1


def test_empty_tables(spark, tmp_path):
    d = table(spark, tmp_path, [])
    for q in (lm_scoring.op3_lm_scoring, line_templates.op6_line_dedup, near_duplicates.op8_near_duplicates, repeats.op9_suffix_dedup, quality_rules.op10_quality_rules):
        assert q(spark, d).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, "\n".join(prose(rng, 30) for _ in range(3)), f"h{i % 3}") for i in range(30)]
    rows += [(100 + i, rows[0][1] + f" tail{i}", "h1") for i in range(5)] + [(200, "short", "h"), (201, None, None)]
    docs = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert kept[:4] == [35, 35, 30, 30]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(range(30))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1]
