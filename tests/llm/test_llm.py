import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.llm import cosine_join, leakage, mixture, overlap, quality
from wardstream import runtime
from wardstream.schema import FEATURES


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- near-equal records ----


def vectors(n, m, seed):
    """Random vectors with near copies at, inside and outside the tolerance, zeros, signs, ties."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.uniform(size=(n, m)) < 0.3, 0.0, np.exp(rng.uniform(-5, 9, (n, m)))) * rng.choice([1, 1, -1], (n, m))
    near = x[: n // 2] * (1 + rng.uniform(-0.0049, 0.0049, (n // 2, m)))
    off = x[: n // 4] * (1 + rng.uniform(-0.02, 0.02, (n // 4, m)))
    return np.concatenate([x, near, off, x[: n // 4]])


def near(a, b, tol=0.005):
    return (np.abs(a - b) <= tol * np.maximum(np.abs(a), np.abs(b))).all()


@pytest.mark.parametrize("chunk", [cosine_join.CHUNK, 1, 2])
def test_near_pairs_lose_nothing(spark, chunk):
    x = vectors(60, 7, 1)
    side = [i % 2 == 0 for i in range(len(x))]
    keys = {}
    data = []
    for v, left in zip(x, side):
        k = keys.setdefault(tuple(v), len(keys))
        data.append((k, k * 7, [float(y) for y in v], left))
    df = spark.createDataFrame(data, "k1 long, k2 long, x array<double>, left boolean")
    lefts, rights = {k for k, _, _, s in data if s}, {k for k, _, _, s in data if not s}
    by = {k: np.array(v) for v, k in keys.items()}
    want = {(a, b) for a in lefts for b in rights if near(by[a], by[b])}
    got = [(r.a1, r.b1) for r in cosine_join.near_pairs(df, 7, 0.005, chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_bounds_hold_for_every_near_pair():
    grid = cosine_join.Grid(33, 0.005)
    a = vectors(80, 33, 2)[:80]
    b = a * (1 + np.random.default_rng(3).uniform(-0.004975, 0.004975, a.shape))
    assert (cosine_join.dot(a, b, grid) >= grid.threshold).all()
    la, ta, wa, _ = cosine_join.index_rows(a, grid, True)
    lb, tb, wb, nb = cosine_join.index_rows(b, grid, False)
    for i in range(len(a)):  # lists with only this record: their largest weight is its own
        most = dict(zip(ta[la == i], wa[la == i]))
        mine = lb == i
        assert any(w * most.get(t, 0.0) > grid.spare / n for t, w, n in zip(tb[mine], wb[mine], nb[mine]))
    ix, _, w = cosine_join.terms(a, grid)
    assert np.allclose(np.bincount(ix, w * w), 1.0)


def test_a_dense_list_is_cut_and_dealt(spark):
    """Many distinct vectors in one cell of the grid: no cell gets more than a fixed number of comparisons, and no pair is lost."""
    rng, n, m = np.random.default_rng(5), 6000, 7
    x = 1.2 * np.exp(rng.uniform(0, 0.02, (n, m)))
    x[:, 0] *= np.exp(rng.uniform(0, 0.3, n))
    df = spark.createDataFrame([(i, i, [float(v) for v in x[i]], i % 2 == 0) for i in range(n)], "k1 long, k2 long, x array<double>, left boolean")
    chunk = 200
    lists = df.withColumn("term", F.lit(1).cast("long"))
    cells = cosine_join._dealt(cosine_join._cut(lists, m, 0.005, chunk), chunk)
    sizes = [(r.l, r.r) for r in cells.groupBy("cell").agg(F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r")).collect()]
    assert max(a * b for a, b in sizes) <= 2 * chunk**2 and sum(a * b for a, b in sizes) < n * n / 4 / 8
    got = {(r.a1, r.b1) for r in cosine_join.near_pairs(df, m, 0.005, chunk).collect()}
    want = {(i, j) for i in range(0, n, 2) for j in np.flatnonzero((np.abs(x - x[i]) <= 0.005 * np.maximum(x, x[i])).all(axis=1)) if j % 2}
    assert got == want and len(want) > 100


def test_a_list_that_no_slice_cuts_is_dealt_on_both_sides(spark):
    """20,000 x 20,000 distinct vectors so alike that slices don't tell them apart."""
    x = F.array(*[F.lit(1.2) + F.col("id") * 1e-9] * 3)
    lists = spark.range(40_000).select(F.lit(1).cast("long").alias("term"), (F.col("id") % 2 == 0).alias("left"), F.col("id").alias("k1"), F.col("id").alias("k2"), x.alias("x"))
    cells = cosine_join._dealt(cosine_join._cut(lists, 3, 0.005, cosine_join.CHUNK), cosine_join.CHUNK)
    sizes = [(r.l, r.r) for r in cells.groupBy("cell").agg(F.count_if("left").alias("l"), F.count_if(~F.col("left")).alias("r")).collect()]
    assert len(sizes) == 100 and sum(a * b for a, b in sizes) == 20_000**2 and max(a * b for a, b in sizes) < 1.3 * cosine_join.CHUNK**2


def flow_table(spark):
    base = {c: 2.0 for c in FEATURES} | {"f3": 1.0, "f4": 1.0, "f5": 1000.0}
    specs = [(1, "train", {}, 0), (2, "train", {}, 1), (3, "cal", {}, 0), (4, "deploy", {"f5": 1004.9}, 1), (5, "deploy", {"f5": 1006.0}, 0), (6, None, {}, 0), (7, "cal", {"f3": 0.0}, 0), (8, "cal", {"f9": float("nan")}, 0), (9, "train", {"f9": None}, None), (10, "deploy", {"f9": float("-inf")}, None), (11, "cal", {"f20": -0.0}, 0), (12, "train", {"f20": 0.0}, 0)]
    data = [(i, 1, "s", s, y, *[(base | o)[c] for c in FEATURES], -1) for i, s, o, y in specs]
    cols = "ingest_id long, ts long, sensor string, split string, label int, " + ", ".join(f"{c} float" for c in FEATURES) + ", k1 long"
    return spark.createDataFrame(data, cols)


def test_overlap_rules(spark):
    f = flow_table(spark)
    assert rows(overlap.overlap_pairs(f)) == [(1, 3), (1, 4), (11, 12), (2, 3), (2, 4), (8, 9), (9, 10)]
    got = {r.split: (r.n_flows, r.n_exact, r.n_near, r.n_same_label, r.n_pairs) for r in overlap.overlap_counts(f).collect()}
    assert got == {"cal": (3, 3, 3, 2, 4), "deploy": (3, 1, 2, 1, 3)}
    assert overlap.overlap_pairs(f.limit(0)).count() == 0 and overlap.overlap_counts(f.limit(0)).count() == 0


def test_audit_report(spark):
    f = flow_table(spark)
    said = [(1, 3, 2, "2025-01-01"), (2, 3, 0, "2024-01-01"), (3, 4, 0, None), (4, 5, 3, "2025-01-01"), (5, None, 1, None), (6, 8, None, "2025-01-01"), (7, 999, 1, None), (8, 11, 0, "2025-01-01"), (9, 11, 0, "2025-01-01")]
    c = spark.createDataFrame(said, "audit_id long, ingest_id long, n_identical_train int, at string").withColumn("audited_at", F.to_timestamp("at")).withColumn("split", F.lit("x"))
    got = {r.split: (r.n_flows, r.n_audited, r.n_confirmed, r.n_stale, r.n_missed, r.n_almost, r.n_unaudited) for r in overlap.audit_report(f, c).collect()}
    assert got == {"cal": (3, 2, 1, 0, 1, 0, 1), "deploy": (3, 2, 0, 1, 0, 1, 1)}
    assert overlap.audit_report(f.limit(0), c).count() == 0 and overlap.audit_report(f, c.limit(0)).count() == 2


# ---- leaks ----


def brute_leaks(text, items, run=13):
    w, out = leakage.words(text), set()
    for i, p in items:
        q = leakage.words(p)
        n = min(run, len(q))
        if n and {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}:
            out.add(i)
    return out


def brute_cover(text, passage, run=13):
    """Longest stretch of covered words, covered words, words."""
    w, q = leakage.words(text), leakage.words(passage)
    n = min(run, len(q))
    grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
    cover = [any(tuple(w[k : k + n]) in grams for k in range(max(0, i - n + 1), i + 1)) for i in range(len(w))]
    best = here = 0
    for c in cover:
        here = here + 1 if c else 0
        best = max(best, here)
    return best, sum(cover), len(w)


def leak_case(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 9, 12, 13, 20, 40])))) for i in range(25)] + [(90, ""), (91, None), (92, "!?"), (93, "w1 w1 w1 w1 w1")]
    items.append((94, items[3][1]))
    docs = []
    for j in range(60):
        body = rng.choices(vocab, k=rng.randint(0, 60))
        if j % 3 == 0:
            body[10:10] = items[rng.randrange(25)][1].split()[: rng.randint(5, 40)]
        docs.append((j, rng.choice([" ", "\n", ", ", "\u00ad \u200b"]).join(body).upper() if j % 2 else "-".join(body)))
    return items, docs + [(100, None), (101, ""), (102, " ".join(vocab * 20_000))]


@pytest.mark.parametrize(("block", "bytes_"), [(leakage.BLOCK_WORDS, leakage.PASS_BYTES), (60, leakage.PASS_BYTES), (60, 1)])
def test_leaks_match_brute_force(spark, block, bytes_):
    items, docs = leak_case(1)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame(items, "item_id long, passage string")
    got = {}
    text = dict(docs)
    for r in leakage.find_leaks(d, e, block_words=block, pass_bytes=bytes_).collect():
        assert (r.doc_id, r.item_id) not in got and 1 <= r.longest_run <= r.covered_words <= r.n_words
        got[(r.doc_id, r.item_id)] = r
    want = {(i, x) for i, t in docs if t for x in brute_leaks(t, [(a, b) for a, b in items if b])}
    assert set(got) == want and len(want) > 50
    for (i, x), r in got.items():
        if i < 100:
            assert (r.longest_run, r.covered_words, r.n_words) == brute_cover(text[i], dict(items)[x])
    assert leakage.find_leaks(d.limit(0), e).count() == 0 and leakage.find_leaks(d, e.limit(0)).count() == 0


def test_joined_word_marks():
    assert leakage.words("Ab\u00adc D\u200be-\u00c9f 1") == ["abc", "de", "f", "1"]
    assert [w for w, _, _ in leakage.word_spans("Ab\u00adc \u0130x D")] == leakage.words("Ab\u00adc \u0130x D")


@pytest.mark.parametrize(("block", "bytes_"), [(leakage.BLOCK_WORDS, leakage.PASS_BYTES), (60, 1)])
def test_removal_takes_every_item_into_account(spark, block, bytes_):
    items, docs = leak_case(2)
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    text = dict(docs)
    for r in leakage.remove_leaks(d, e, max_coverage=1.0, block_words=block, pass_bytes=bytes_).collect():
        if r.doc_id < 100 and text[r.doc_id]:
            w, keep = leakage.words(text[r.doc_id]), []
            hit = [False] * len(w)
            for _, p in items:
                q = leakage.words(p or "")
                n = min(13, len(q))
                grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
                for k in range(len(w) - n + 1):
                    if n and tuple(w[k : k + n]) in grams:
                        hit[k : k + n] = [True] * n
            keep = [x for x, h in zip(w, hit) if not h]
            assert leakage.words(r.text) == keep


def test_removal_cuts_spans_or_drops(spark):
    p = " ".join(f"t{i}" for i in range(15))
    d = spark.createDataFrame([(1, "Before it all, there were many words of prose that nobody had leaked. " + p.upper() + "! After, too, and on and on."), (2, p), (3, None), (4, "clean"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in leakage.remove_leaks(d, spark.createDataFrame([(7, p)], "item_id long, passage string"), max_coverage=0.6).collect()}
    assert got[1].text == "Before it all, there were many words of prose that nobody had leaked. ! After, too, and on and on." and got[1].n_spans == 1
    assert got[2].dropped and got[2].text is None and got[3].text is None and not got[3].dropped and got[4].text == "clean" and got[5].text == ""


# ---- mixtures ----


def test_permutations_are_bijections():
    for n in (1, 2, 3, 17, 1000):
        for key in (0, 5, -(2**63)):
            got = mixture.permute(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got) == list(range(n))
    assert list(mixture.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1))) != list(range(1000))


def test_quotas_respect_caps_and_shares():
    sizes = {"a": (100, 10_000), "b": (5, 500), "c": (50, 5_000)}
    q = mixture.quotas(sizes, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 9), "none": (0.1, 3)}, 16_000)
    assert q == {"a": 100, "b": 10, "c": 50, "none": 0}
    q = mixture.quotas(sizes, {"a": (0.5, 1), "c": (0.5, 2)}, 16_000)
    assert q == {"a": 80, "c": 80}
    assert mixture.quotas({}, {"a": (1.0, 1)}, 0) == {"a": 0}


def test_draws_are_exact_and_random():
    quota, blocks = np.array([1000, 77, 3]), np.array([400, 77, 1])
    src, slot, ix = mixture.draw(np.arange(1080), quota, blocks, 1)
    assert list(np.bincount(src)) == [1000, 77, 3]
    for s in range(3):
        assert sorted(slot[src == s]) == list(range(quota[s]))
        uses = np.bincount(ix[src == s], minlength=blocks[s])
        assert len(uses) == blocks[s] and uses.max() - uses.min() <= 1
    again = mixture.draw(np.arange(500, 600), quota, blocks, 1)
    assert (again[0] == src[500:600]).all() and (again[2] == ix[500:600]).all()  # any part of the slots gives the same
    assert (mixture.draw(np.arange(1080), quota, blocks, 2)[0] != src).any()
    # Counts per shard of 64 slots have the mean and variance of draws without replacement.
    big = mixture.draw(np.arange(64_000), np.array([16_000, 48_000]), np.array([16_000, 48_000]), 5)[0].reshape(1000, 64)
    n = (big == 0).sum(axis=1)
    assert abs(n.mean() - 16) < 1e-9 and 10 < n.var() < 14
    far = mixture.draw(np.array([0, 4 * 10**12 - 1]), np.array([3 * 10**12, 10**12]), np.array([3 * 10**12, 10**12]), 1)
    assert (far[1] < np.array([3 * 10**12, 10**12])[far[0]]).all()


def test_mixture_invariants(spark):
    rng = random.Random(0)
    word = lambda: rng.choice(["alpha ", "beta, ", "gamma ", "delta. "])
    docs = [(i, "".join(word() for _ in range(rng.randint(0, 60))) or None, rng.choice(["A ", "a", " B", "c", "other", None])) for i in range(300)] + [(900, "", "a"), (901, "x " * 20_000, "a")]
    d = spark.createDataFrame([(i, t, s, 0) for i, t, s in docs], "doc_id long, text string, source string, shard int").repartition(5)
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 3), ("c", 0.15, 1), ("missing", 0.05, 2)], "source string, target_share double, max_repeats int")
    enc = mixture.encoder(mixture.TOKENIZER)
    size = {i: len(enc.encode_ordinary(t)) for i, t, _ in docs if t}
    blocks = mixture.pack(d, ["a", "b", "c"], 32).collect()
    for s in "abc":
        mine = [b for b in blocks if b.source == s]
        used = Counter()
        for b in mine:
            assert len(b.tokens) == b.n_tokens == sum(b.doc_tokens)
            for i, n in zip(b.doc_ids, b.doc_tokens):
                used[i] += n
        assert used == {i: size[i] for i, t, src in docs if t and (src or "").strip().lower() == s}
        assert sum(b.n_tokens < 32 for b in mine) <= 1
    plan = mixture.plan(d, targets, 32, 16)
    m = plan.rows().collect()
    per = Counter(r.shard for r in m)
    assert set(sorted(per.values())[1:]) == {16} and sum(r.n_blocks for r in plan.shard_counts().collect()) == len(m)
    for s, most in (("a", 1), ("b", 3), ("c", 1)):
        uses = Counter(tuple(r.tokens) + tuple(r.doc_ids) for r in m if r.source == s)
        have = Counter(tuple(b.tokens) + tuple(b.doc_ids) for b in blocks if b.source == s)
        assert all(n <= most * have[k] for k, n in uses.items())
    report = {r.source: r for r in plan.shares().collect()}
    total = sum(r.n_tokens for r in m)
    assert report["missing"].mixture_tokens == 0 and report["a"].corpus_tokens == sum(size.values())
    for s in "abc":
        assert report[s].mixture_tokens == sum(r.n_tokens for r in m if r.source == s) and report[s].actual_share == pytest.approx(report[s].mixture_tokens / total)
        assert report[s].most_uses <= report[s].max_repeats
    text = enc.decode([t for b in sorted((b for b in blocks if 901 in b.doc_ids and b.source == "a"), key=lambda b: (b.part, b.seq)) for i, n, o in zip(b.doc_ids, b.doc_tokens, np.cumsum([0, *b.doc_tokens])) if i == 901 for t in b.tokens[o : o + n]])
    assert text == "x " * 20_000
    assert mixture.plan(d.limit(0), targets, 32, 16).rows().count() == 0 and mixture.plan(d, targets.limit(0), 32, 16).rows().count() == 0
    assert runtime.release(spark) >= 9 and runtime.release(spark) == 0


# ---- quality ----

PROSE = "The analyst on duty wrote in the draft that the threshold agrees with the packet trace. Nobody has checked this twice, so the index can be closed."
QUALITY = {
    "prose": [
        PROSE, "> " + PROSE.replace(" that ", " that\n> "), PROSE.lower().replace(".", ""), "Wir haben die Aufzeichnung noch einmal abgespielt und dieselben Fälle gefunden. Das Budget war nach Mitternacht aufgebraucht.",
        "Eelarve sai otsa pärast seitset episoodi ja meetod vaikis hommikuni.", PROSE.replace(" ", "  "), "- " + PROSE.replace(". ", ".\n- "), PROSE + "\n\nIt’s late.", " ".join([PROSE] + [f"Then the shift number {i} found {i * 7} flows in the segment." for i in range(40)]),
    ],
    "list": ["- one thing;\n- another thing;\n  - a third", "1. rerun the order\n2. ask the team about ranks\n3. kossti-14", "(1) alpha;\n(2) beta;", "rerun the order;\nkossti-14;\nthe draft, around noon;", "alpha beta\ngamma\ndelta-04\nthe draft, around noon", "R1-1: tovke-36\nR2-1: stale alarm", "- [ ] host pair.\n- [ ] dopra-03.", "rastov-29, baul-31, rerun the feedback variant, rudul-01, rastov-23, ziwo-50, the appendix, in the last hour, nevnoul-16"],
    "table": ["| a | b |\n|---|---|\n| 1 | 2 |", "a,b,c\n1,2,x\n0.5,,y", "a\tb\tc\n1\t2\t3", "n      host     late\n1      ulzi     2:39\n20     kerud    -", "\\begin{tabular}{ll}\na & b \\\\\n1 & 2 \\\\\n\\end{tabular}", "a;b;c\n1;2;3"],
    "junk": ["HMQDzOaQNopD4oKcBRyzzQKFabjHEH91Nt2WKDQt8lF1FfuPXmsOejldWIOdCJ0zEyhWcDUR", "0 0 0 0 0 0 0 0", "-----------\n-----------", "00000000  3a af 82 86 04 d3 94 fe  |:.......|", "O¶n™ ein¤€¤estâ™O¤Ãnung Ã¶tÃ¤™ Ã¤™¤Ã€¿", "noisy beacon - " * 20, "fzdp kq;fipk wpadde;jqjudj edae dkpkrlq tldr fe; sf z;a;jfr;ltt jfusljjqktuua klrooqaa ap;tdqffsz"],
}


def test_kinds(spark):
    data = [(k, t) for k, ts in QUALITY.items() for t in ts]
    d = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(data)], "doc_id long, text string, kind string")
    got = {r.doc_id: r.kind for r in quality.text_quality(d).collect()}
    wrong = [(got[i], k, t[:60]) for i, (k, t) in enumerate(data) if got[i] != k]
    assert not wrong
    assert {(r.doc_id, r.kind) for r in quality.not_prose(d).collect()} == {(i, k) for i, (k, _) in enumerate(data) if k != "prose"}


def test_statistics_and_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, " \r\n\ufeff\t"), (4, "\ufeffThe cat sat.\r\nOn the mat...\r- x"), (5, "a " * 500_000), (4, "\ufeffThe cat sat.\r\nOn the mat...\r- x")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.text_quality(d).collect()}
    assert quality.text_quality(d).count() == 6
    assert [got[i].kind for i in (1, 2, 3)] == [None, None, None] and got[1].n_words == 0 and got[1].mean_word_length == 0
    x = got[4]
    assert (x.n_words, x.n_lines) == (8, 3) and x.end_punct_share == pytest.approx(2 / 3) and x.bullet_share == pytest.approx(1 / 3) and x.ellipsis_share == pytest.approx(1 / 3)
    assert [list(got[i].reasons) for i in (1, 2, 3)] == [[], [], []] and got[5].reasons[0] == "too_many_words" and "few_distinct_words" in got[5].reasons
    assert "too_few_words" in x.reasons and got[5].kind == "junk" and got[5].n_words == 500_000
    assert quality.not_prose(d.limit(0)).count() == 0


def test_sentences_are_counted_in_every_text(spark):
    said = "No. " * 20 + " ".join(f"word{i}" for i in range(100))
    d = spark.createDataFrame([(1, PROSE), (2, said), (3, "Same. Same. Same. "), (4, " \n"), (5, None), (6, "it is so. " * 12)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.text_quality(d).collect()}
    assert [got[i].n_sentences for i in range(1, 7)] == [2, 21, 4, 0, 0, 13]
    assert [got[i].repeated_sentence_share for i in range(1, 7)] == pytest.approx([0, 19 / 21, 2 / 4, 0, 0, 11 / 13])
    assert got[2].kind == "prose" and "said_again" not in got[2].reasons and "said_again" in got[6].reasons and got[6].kind == "junk"


def test_the_kind_follows_from_the_reasons(spark):
    rules = list(quality.RULES)
    cases = [([], "prose"), (["too_few_words", "line_ends"], "prose"), (["garbled"], "junk"), (["said_again", "table_lines"], "table"), (["list_lines", "one_pair"], "junk"), (["list_lines"], "list"), (["partly_table"], "prose"), (["line_ends", "partly_table"], "table"), (["junk_lines", "table_lines"], "junk")]
    df = spark.createDataFrame([(r, 9, k) for r, k in cases] + [([], 0, None)], "reasons array<string>, n long, want string").withColumn("got", F.expr(quality.kind_of("reasons", "n")))
    assert all(r.got == r.want for r in df.collect()) and len(rules) == len(set(rules))


def test_batches_do_not_change_figures():
    import pyarrow as pa

    texts = [t for ts in QUALITY.values() for t in ts] + [None, "", "x\r\rx", "a b " * 2000]
    whole = quality.measure(pa.array(texts))
    for i, t in enumerate(texts):
        one = quality.measure(pa.array([t], pa.string()))
        assert all(one[k][0] == pytest.approx(whole[k][i]) for k in whole), t
    assert all(len(v) == 0 for v in quality.measure(pa.array([], pa.string())).values())


def test_slices_cover_all_rows_once():
    from wardstream.llm.batches import slices

    rng = np.random.default_rng(0)
    for sizes in ([], [0, 0], [5], [99, 1, 1], list(rng.integers(0, 30, 200))):
        got = list(slices(np.array(sizes), 40))
        assert [x for i, j in got for x in range(i, j)] == list(range(len(sizes)))
        assert all(sum(sizes[i:j]) <= 40 or j - i == 1 for i, j in got)


def test_llm_queries_agree_with_sql(spark, sf):
    from pathlib import Path

    import duckdb

    from tools.compare import canon
    from wardstream.llm import plans

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    for name, q in plans.QUERIES.items():
        got = q(spark, sf).toPandas()
        if name in plans.SQL:
            assert canon(got) == canon(c.execute(plans.SQL[name]).df()), name
