"""The pipeline's near copies are joined by SimHash as well as by Jaccard similarity."""

import corpus_pipeline
from estatemap.llm import simhash
from .test_dedup import documents


def test_stage_links_equal_fingerprints(spark):
    # A few words outvoted by a long run: the fingerprints are near, the sets of shingles are not.
    run = " ".join(["a b c"] * 400)
    rows = [(1, run), (2, run + " " + " ".join(f"x{i}" for i in range(40))), (3, "something else that stands alone here"), (4, None)]
    apart = bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1")
    assert apart <= simhash.BITS
    kept = {row.doc_id for row in corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect()}
    assert kept == {1, 3, 4}
