import collections
import random

from tidewright.llm import mixing

DOCS = "doc_id bigint, text string, source string, n_tokens string, copies string"
TARGETS = "source string, target_share double, max_repeats int, wanted string"


def corpus(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "12", "run=3", "delta"]
    data = []
    for i in range(600):
        source = rng.choice(["big"] * 12 + ["mid"] * 4 + ["small", "other", None])
        data.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), source, "x", "x"))
    data += [(1000, None, "big", "x", "x"), (1001, "", "mid", "x", "x")]
    return spark.createDataFrame(data, DOCS)


def targets(spark, rows=(("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.25, 2), ("absent", 0.05, 4))):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGETS)


def test_mix_by_brute_force(spark):
    sized = mixing.sized_documents(corpus(spark))
    docs = sized.collect()
    total = sum(d.n_tokens for d in docs)
    got = {r.doc_id: r.copies for r in mixing.mix(sized, targets(spark)).collect()}
    want = {}
    for source, share, most in (("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.25, 2)):
        own = sorted((d.sampling_key, d.doc_id, d.n_tokens) for d in docs if d.source == source and d.n_tokens)
        have = sum(n for *_, n in own)
        wanted = min(share * total, most * have)
        epochs, before = int(wanted // have), 0
        for _, i, n in own:
            copies = epochs + (before + n / 2 <= wanted - epochs * have)
            before += n
            if copies:
                want[i] = copies
    assert got == want
    assert max(collections.Counter(got.values())) <= 3


def test_shares(spark):
    sized = mixing.sized_documents(corpus(spark))
    shares = {r.source: r for r in mixing.mix_shares(sized, targets(spark)).collect()}
    longest = max(d.n_tokens for d in sized.collect())
    total = sum(d.n_tokens for d in sized.collect())
    for s in ("big", "mid"):
        assert not shares[s].capped and abs(shares[s].mixed_tokens - shares[s].target_share * total) <= longest
    assert shares["small"].capped and shares["small"].mixed_tokens == 2 * shares["small"].available_tokens and shares["small"].most_copies == 2
    assert shares["absent"].mixed_tokens == 0 and shares["absent"].capped
    assert abs(sum(r.share_of_mix for r in shares.values()) - 1) < 1e-9


def test_weights_come_first(spark):
    rows = [(i, "plain words of text here" if i % 2 else "1|2|3|4|5|6|7|8", "big", "", "") for i in range(2000)]
    sized = mixing.sized_documents(spark.createDataFrame(rows, DOCS))
    taken = [r.doc_id for r in mixing.mix(sized, targets(spark, [("big", 0.2, 1)])).collect()]
    assert sum(i % 2 for i in taken) > 0.8 * len(taken)


def test_quality_rules(spark):
    prose = "The panel holds six hour candles of two assets and every gap in it is listed. " * 5
    texts = [prose, "too short", "x " * 60, "1234 223 333 4444 " * 20, "# " * 15 + prose, "\n".join(["- " + prose] * 3), "\n".join([prose[:-2] + "..."] * 3), "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    rules = mixing.quality_rules(df["text"])
    rows = df.select(*[r.alias(str(k)) for k, r in enumerate(rules.values())], mixing.quality_weight(df["text"]).alias("w")).collect()
    broken = [[k for k in range(6) if not r[str(k)]] for r in rows]
    assert broken[:7] == [[], [0], [1], [2], [3], [4], [5]]
    assert rows[0].w == 1.0 and rows[1].w == 1 / 3 and rows[7].w == rows[8].w == mixing.LEAST_WEIGHT


def test_many_sources(spark, monkeypatch):
    sized = mixing.sized_documents(corpus(spark))
    want = sorted(map(str, mixing.mix(sized, targets(spark)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(sized, targets(spark)).collect())) == want


def test_defined_cases(spark):
    docs = corpus(spark)
    sized = mixing.sized_documents(docs)
    odd = targets(spark, [(None, 0.5, 1), ("mid", None, 1), ("big", 0.1, None), ("big", 0.05, 2), ("small", -1.0, 1), ("other", 0.0, 1)])
    used = mixing.mix(sized, odd).collect()
    assert {r.source for r in used} == {"big"} and {r.copies for r in used} == {1}
    assert {r.source for r in mixing.mix_shares(sized, odd).collect()} == {"big", "other"}
    empty = mixing.sized_documents(docs.limit(0))
    assert mixing.mix(empty, targets(spark)).count() == 0
    assert {r.mixed_tokens for r in mixing.mix_shares(empty, targets(spark)).collect()} == {0}
    assert mixing.mix(sized, targets(spark, [])).count() == 0
    twice = mixing.sized_documents(docs.unionByName(docs))
    assert mixing.mix(twice, targets(spark)).count() > 0
