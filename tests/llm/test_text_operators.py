"""Near-dedup, repeated strings, decontamination and language models against brute force."""
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from feedyard.llm import hmm, hyperminhash, kneser_ney, suffixmerge, wumanber  # noqa: E402

DOC = "doc_id long, text string, n long, kept string, doc string"  # with columns that clash


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 8))) for _ in range(n)]


def corpus(seed=3):
    """Random texts with copies, near copies, shared passages, nulls, empties and one long text."""
    rng = random.Random(seed)
    voc = vocabulary(rng)

    def text(n):
        return " ".join(rng.choice(voc) for _ in range(n))

    rows = [(i, text(rng.choice([1, 2, 3, 8, 40, 120, 300]))) for i in range(60)]
    base = [r[1] for r in rows if len(r[1].split()) > 30]
    for i in range(60, 100):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = rng.choice(voc)
        rows.append((i, rng.choice([" ", "\t", " \n"]).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    passage = text(90)
    for i in range(100, 112):
        rows.append((i, text(rng.randint(0, 30)) + " " + passage + " " + text(rng.randint(0, 30))))
    rows += [(112, None), (113, ""), (114, " \n\t "), (None, rows[70][1]), (None, None), (115, rows[70][1]), (115, rows[70][1]), (116, text(5)), (116, text(6)),
             (117, text(4000)), (118, "one"), (119, "ONE"), (120, "a" * 1500), (121, "ab " * 700)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOC).repartition(3)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    rows, df = docs
    want = brute.near_duplicates(rows, k, 80)
    got = hyperminhash.near_duplicates(df, k, 80).select("doc_id", "row", "n_shingles", "component_id", "kept").collect()
    assert len(got) == len(rows)
    by = sorted((str(i), n, str(c), k_) for (i, t), (n, c, k_) in want.items() for _ in range(sum(x == (i, t) for x in rows)))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == by


def test_keep_one(docs):
    rows, df = docs
    want = brute.near_duplicates(rows, 5, 80)
    out = hyperminhash.keep_one(df)
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    named = [i for i in got if i is not None]
    assert sorted(named) == sorted({i for (i, _), v in want.items() if i is not None and v[2]})
    assert got.count(None) == 2


def test_near_dedup_stage_judges_each_text(docs, spark):
    """Repeated ids over different texts and rows without id: one row of each group of texts stays."""
    import corpus_pipeline
    rng = random.Random(21)
    voc = vocabulary(rng)
    rows = list(docs[0])
    a, b, c = (" ".join(rng.choice(voc) for _ in range(80)) for _ in range(3))
    rows += [(200, a), (201, a + " more"), (201, b), (201, c), (None, c + " end"), (None, "x " + c)]
    d = " ".join(rng.choice(voc) for _ in range(80))
    rows += [(None, d + f" {i % 7}") for i in range(20)] + [(None, "")] * 3
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOC).repartition(3)
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    one = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    comp = [v[1] for v in brute.near_duplicates([(n, t) for n, (_, t) in enumerate(one)], 5, 80).values()]
    left = {}
    for r in out.collect():
        group = comp[one.index((r.doc_id, r.text))]
        assert group not in left  # one row of a group
        left[group] = r.doc_id
    assert left == {g: one[g][0] for g in comp}  # of the smallest doc_id
    assert {b, c} <= {r.text for r in out.collect()}


def test_large_group_of_near_copies(spark):
    """Hundreds of copies of one text that differ pairwise: one component, no pair listing."""
    rng = random.Random(9)
    voc = vocabulary(rng)
    base = [rng.choice(voc) for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"edit{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    want = brute.near_duplicates(rows, 2, 80)
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, v[1]) for (i, _), v in want.items()}


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    a, b = h[:2400], np.unique(np.concatenate([h[:2000], h[2400:]]))
    ra, rb = hyperminhash.registers([a, b, h[:0]])[:2]
    j, used = hyperminhash.estimate(ra, rb)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert used == 256 and abs(j - true) < 0.12
    assert hyperminhash.estimate(ra, ra)[0] == 1.0
    assert not hyperminhash.registers([h[:0]]).any()


def test_repeats(docs, monkeypatch):
    rows, df = docs
    want = brute.repeats(rows)
    for limit in (suffixmerge.RANGE_BYTES, 20_000):  # one range, and many
        monkeypatch.setattr(suffixmerge, "RANGE_BYTES", limit)
        got = suffixmerge.cut(df, texts=False).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert any(w[1] for w in want)


def test_hot_anchor_strings(docs, monkeypatch):
    """Anchors of frequent strings are counted window by window: the same decision."""
    rows, df = docs
    want = sorted((str(i), *w) for (i, _), w in zip(rows, brute.repeats(rows), strict=True))
    for hot in (0, 3):
        monkeypatch.setattr(suffixmerge, "HOT", hot)
        got = suffixmerge.cut(df, texts=False).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == want


def test_other_lengths(docs):
    rows, df = docs
    for length in (40, 203):
        got = suffixmerge.cut(df, texts=False, length=length).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, brute.repeats(rows, length), strict=True))


def test_remove_keeps_columns_and_nulls(docs):
    rows, df = docs
    out = suffixmerge.remove(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[112] is None and got[113] == ""
    assert len(got[120]) == 0


def test_merge_order_and_prefixes():
    rng = random.Random(4)
    entries = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 14))), b"x", 0, 1) for _ in range(500))
    runs = [suffixmerge.front_code(entries[i::9]) for i in range(9)]
    got = list(suffixmerge.merge(runs))
    assert [e for _, e in got] == entries
    before = b""
    for c, e in got:
        assert c == suffixmerge.common(before, e[0])
        before = e[0]
    assert list(suffixmerge.merge([])) == []


@pytest.fixture(scope="module")
def items(docs):
    rows, _ = docs
    long = [t for _, t in rows if t and len(t.split()) > 60]
    return [(1, " ".join(long[0].split()[5:40])), (2, long[3].upper()), (10, " ".join(long[5].split()[:10])), (2, " ".join(long[7].split()[3:20])),
            (3, "no such words here at all in any of the given texts"), (4, None), (5, ""), (6, "one"), (7, "absent words"), (None, " ".join(long[9].split()[:12]))]


def test_contamination(spark, docs, items):
    rows, df = docs
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc string")
    want = brute.contamination(rows, items)
    for size in (wumanber.BLOCK_BYTES, 300):  # one pass, and several
        got = wumanber.contamination(df, bench, block_bytes=size).select("doc.doc_id", "n_words", "n_hit", "items", "items_sha256").collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    left = wumanber.clean(df, bench)
    assert left.columns == df.columns
    assert left.count() == sum(not w[1] for w in want)


def test_repeated_benchmark_rows_are_one(spark, monkeypatch):
    passes = []
    scan = wumanber._scan
    monkeypatch.setattr(wumanber, "_scan", lambda *a, **k: (passes.append(1), scan(*a, **k))[1])
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([("i", text)] * 2000 + [(None, text)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {text} it goes"), (2, "nothing of it")], "doc_id long, text string")
    got = wumanber.contamination(docs, bench, block_bytes=1000).select("doc.doc_id", "n_hit", "items").collect()
    assert len(passes) == 1 and {(r.doc_id, r.n_hit, tuple(r["items"])) for r in got} == {(1, 30, ("", "i")), (2, 0, ())}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words here", "en", "a", 15)], none.schema)
    assert hyperminhash.near_duplicates(none).count() == 0
    assert hyperminhash.keep_one(none).count() == 0
    assert suffixmerge.remove(none).count() == 0
    assert wumanber.clean(none, bench).count() == 0
    assert wumanber.clean(one, bench).count() == 1
    assert kneser_ney.predict(none).count() == 0
    assert hmm.score(none, kneser_ney.held_out(F.col("doc_id"), 10, 0)).count() == 0


def test_unigram_and_chain(docs):
    rows, df = docs
    want = brute.unigram(rows)
    got = hmm.score(df, kneser_ney.held_out(F.col("doc_id"), 10, 0)).collect()
    a = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert a == sorted((str(i), *w[:4], round(w[4], 4)) for i, t in rows for w in [want[i, t]])
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_forward_is_exact_likelihood():
    """The scaled recursion against the sum over all state paths."""
    from itertools import product
    rng = np.random.default_rng(2)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    start, move, emit = norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, hmm.SYMBOLS)))
    chain = hmm.Chain(start, start, move, emit)
    seqs = [rng.integers(0, 20, n).astype(np.uint16) for n in (1, 4, 2, 6)]
    want = []
    for s in seqs:
        p = 0.0
        for path in product(range(3), repeat=len(s)):
            x = start[path[0]] * emit[path[0], s[0]]
            for a, b, o in zip(path, path[1:], s[1:], strict=False):
                x *= move[a, b] * emit[b, o]
            p += x
        want.append(np.log10(p))
    assert np.allclose(hmm.loglik(chain, seqs), want)
    first, moves, emits = hmm.expected(chain, seqs, np.array([True] * 4))
    assert np.isclose(first.sum(), 4) and np.isclose(moves.sum(), sum(len(s) - 1 for s in seqs)) and np.isclose(emits.sum(), sum(map(len, seqs)))


def test_baum_welch_raises_likelihood():
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    seqs = [np.array([(i + j) % 4 + 1 for i in range(30)], np.uint16) for j in range(4)]
    chain = hmm.Chain(norm(rng.random(4)), norm(rng.random(4)), norm(rng.random((4, 4))), norm(rng.random((4, hmm.SYMBOLS))))
    last = -np.inf
    for _ in range(6):
        here = hmm.loglik(chain, seqs).sum()
        assert here >= last - 1e-9
        last = here
        s, m, e = hmm.expected(chain, seqs, np.array([True] * 4))
        chain = hmm.Chain(norm(s + 1e-12), chain.share, norm(m + 1e-12), norm(e + 1e-12))


def test_language(spark):
    rng = random.Random(8)
    voc = {"aa": ["thing", "over", "the", "with"], "bb": ["été", "où", "les", "çà"], "cc": ["für", "über", "nicht", "groß"]}
    rows = [(i, " ".join(rng.choice(voc[lang]) for _ in range(rng.randint(3, 60))), lang, "y") for i in range(240) for lang in [rng.choice(list(voc))]]
    rows += [(1000, None, "aa", "y"), (1001, "", "aa", "y"), (1002, "12 + 3!", "bb", "y"), (1003, "the thing over", None, "y"), (None, "les été", None, "y"), (1004, "Ω λ ж 語", None, "y"), (1004, "ÜBER groß", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = kneser_ney.predict(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.lang_pred): r for r in got}
    for i, t, lang, _ in rows[:240]:
        assert (i, lang) in by
    assert all((i, "und") in by and by[i, "und"].score == 0 for i in (1000, 1001, 1002))
    assert (1003, "aa") in by and (None, "bb") in by and (1004, "cc") in by
    assert all(0 <= r.score <= 1 for r in got)
    assert [r for r in got if r.doc_id == 1004 and r.entropy and r.entropy > 5][0].rejected


def test_language_learns_from_rows_not_ids(spark):
    rng = random.Random(9)
    voc = {"aa": ["thing", "over", "the", "with"], "bb": ["été", "où", "les", "çà"]}
    text = lambda lang: " ".join(rng.choice(voc[lang]) for _ in range(12))
    kind = "doc_id long, text string, lang string"
    # no text has an id; a language with one text is learned too
    rows = [(None, text("aa"), "aa") for _ in range(9)] + [(None, "für über nicht groß", "cc")]
    got = kneser_ney.predict(spark.createDataFrame(rows, kind)).collect()
    assert sorted({r.lang_pred for r in got}) == ["aa", "cc"] and all(r.lang_pred != "und" for r in got)
    # the sample's bound holds for one id over many texts, and for many copies of a row
    rows = [(7, text(lang), lang) for lang in voc for _ in range(400)] + [(8, "the thing", "aa")] * 900
    used = []
    counts = kneser_ney._counts

    def counted(df):
        used.append({r.lang: r["count"] for r in df.groupBy("lang").count().collect()})
        return counts(df)

    monkey = pytest.MonkeyPatch()
    monkey.setattr(kneser_ney, "_counts", counted)
    try:
        kneser_ney.fit(spark.createDataFrame(rows, kind).withColumnRenamed("doc_id", "id"), sample=50)
    finally:
        monkey.undo()
    assert set(used[0]) == set(voc) and all(20 <= n <= 50 for n in used[0].values())


def test_kneser_ney_sums_to_one(spark):
    """Over the whole alphabet the interpolated probabilities of a context add up to one."""
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(["abab abba", "baab bab", "abb aab"])], "id long, text string, lang string")
    import pyarrow as pa
    model = kneser_ney.Model(kneser_ney._counts(df.select("lang", "text")).toArrow())
    texts = ["aba" + c for c in "ab"] + ["aba "]
    sym, ends = kneser_ney.symbols(pa.array([t + "a" if t.endswith(" ") else t for t in texts]))
    at = ends[:-1] + kneser_ney.ORDER - 1 + 3
    seen = np.exp(model.logp(sym, at)[:, 0]).sum()
    assert 0.9 < seen <= 1.0
