"""The pipeline's stages on the small tables, each against what it must do to its own input."""

import hashlib
import re

import public_tokenizers
import tiktoken

import __spark_entry__ as registry
import corpus_pipeline
from tellerlens.llm import bpe
from tellerlens.llm.common import stored

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SMALL))
        assert out.columns == docs.columns
        kept[name] = (docs.collect(), out.collect())
        docs = out
    toxic = {r.doc_id for r in kept["toxicity"][0]} - {r.doc_id for r in kept["toxicity"][1]}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(labels.get(i, 1) == 1 for i in toxic)
    lines = [x.strip() for r in kept["line_dedup"][1] for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in kept["line_dedup"][1])
    before, after = kept["jaccard_join"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) == len({r.doc_id for r in after})
    before, after = kept["mixing"]
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert 1.4 * words(before) < words(after) < 1.6 * words(before)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    rows = registry.queries()["pipeline"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, digest(lib.encode_ordinary(r.text))) for r in after)
