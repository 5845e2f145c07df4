"""The text queries over the smallest tables: columns, types and one row for each document."""

import tiktoken

from tidewright.llm import bpe, plans
from tidewright.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def test_ids_of_every_document(spark):
    ranks = bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in plans.p7_ids(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t in texts.items()}


def test_pairs_have_the_columns(spark):
    df = plans.p9_found(spark, SMALL)
    assert df.dtypes == [("doc_id_a", "bigint"), ("doc_id_b", "bigint")]
    assert df.where("doc_id_a >= doc_id_b").count() == 0


def test_mix_stays_within_its_caps(spark):
    most = {r.source: r.max_repeats for r in table(spark, SMALL, "mix_targets").collect()}
    used = plans.p8_mix(spark, SMALL).collect()
    assert used and all(1 <= r.copies <= most[r.source] for r in used)
    shares = plans.p8_shares(spark, SMALL).collect()
    assert {r.source for r in shares} == set(most)
    for r in shares:
        assert sum(u.n_tokens * u.copies for u in used if u.source == r.source) == r.mixed_tokens
