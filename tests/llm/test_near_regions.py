"""Regions of the forest that hold more rows than fit a task lose no candidate."""

import random

import numpy as np
import pyarrow as pa

from tabspark.llm import near_dedup as nd


def test_a_crowded_region_loses_no_link(spark):
    """Texts share half of their words, so regions are large; each has a near copy. All that agree are linked."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for k in range(200):
        own = [f"d{k}w{i}" for i in range(40)]
        copy = [*own]
        copy[rng.randrange(5, 35)] = "other"
        texts += [" ".join(shared + own), " ".join(shared + copy)]
    forest = nd.Forest(trees=1, depth=6, least_depth=1, agree=0.5, region=8)
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    (found,) = nd._signatures(5, forest)([batch])
    signature = np.array([np.frombuffer(s, ">u4") for s in found.column("signature").to_pylist()])
    bytes_ = signature >> 24
    agreeing = [k for k in range(0, len(texts), 2) if signature[k, 0] == signature[k + 1, 0] and (bytes_[k] == bytes_[k + 1]).sum() >= 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    component = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs, forest=forest).collect()}
    assert len(agreeing) > 120
    assert [k for k in agreeing if component[k] != component[k + 1]] == []
