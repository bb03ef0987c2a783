"""The corpus pipeline, stage by stage, each on what the one before kept, against plain versions."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from qvault.llm import mixing, queries, token_planes, toxicity
from qvault.storage import load, materialize

from oracle_helpers import DATA
from test_edges import plain_containment
from test_near_copies import brute


def test_stages_against_plain_versions(spark):
    docs, labels = load(spark, DATA, "documents"), load(spark, DATA, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    before = texts(docs)
    model = toxicity.fit(docs, labels, ~(queries.fold(F.col("doc_id"), 5) == 0))
    scores = dict(zip(before, model.score(pa.array(list(before.values()), pa.string())), strict=True))
    kept, _ = materialize(stages["toxicity"](spark, docs, DATA), "test")
    assert set(texts(kept)) == {i for i, s in scores.items() if s < 0.5}

    before = texts(kept)
    docs, _ = materialize(stages["near_dedup"](spark, kept, DATA), "test")
    assert set(texts(docs)) == {i for i, root in brute(before).items() if i == root}

    before = texts(docs)
    kept, _ = materialize(stages["decontamination"](spark, docs, DATA), "test")
    items = {r["item_id"]: r["text"] for r in load(spark, DATA, "benchmark").collect()}
    assert set(texts(kept)) == set(before) - {d for d, _ in plain_containment(before, items)}

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept, mixing.label_domains(labels), queries.TARGETS).collect()}
    docs, _ = materialize(stages["mixing"](spark, kept, DATA), "test")
    assert Counter(r["doc_id"] for r in docs.select("doc_id").collect()) == Counter({i: n for i, n in copies.items() if n})

    coder = token_planes.WordEncoder(queries.tokenizer_path()).tokenizer
    start, want = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = stages["token_output"](spark, docs, DATA).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
