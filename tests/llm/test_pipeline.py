"""The corpus pipeline, stage by stage, against what each stage promises."""

import collections
import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from fathomtext.llm import bpe, registered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.written(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == columns, name
    before, good, one, cut, mixed = ({r["doc_id"]: r["text"] for r in d.collect()} for d in kept)
    assert sum(labels[i] == 1 for i in set(before) - set(good) if i in labels) <= 2
    assert sum(labels[i] == 0 for i in good if i in labels) <= 2
    copies = collections.defaultdict(list)
    for i, t in good.items():
        copies[t].append(i)
    assert all(len(set(v) & set(one)) <= 1 for v in copies.values()) and set(one) <= set(good)
    words = lambda t: collections.Counter(WORD.findall(t))
    assert set(cut) <= set(one) and all(not words(cut[i]) - words(one[i]) for i in cut)
    assert set(mixed) <= set(cut)
    rows = kept[-1].count()
    out = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    assert len(out) == rows
    ranks = bpe.public_tokenizer(spark).value.ranks
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        assert r["ids"] == oracle.encode_ordinary(mixed[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(mixed[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    some = [tuple(r) for r in docs.collect()]
    odd = [(None, None, None, None, None), (9001, "", "en", None, 0), (9002, None, None, "s", None), some[0], (None, some[1][1], "en", "s", 5)]
    table = spark.createDataFrame([*some, *odd], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.written(stage(spark, table, SF))
        assert table.count() > 0, name
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.written(stage(spark, none, SF))
        assert none.count() == 0, name


def test_names():
    assert set(registered.SQL) <= set(registered.QUERIES)
    numbers = {re.match(r"op(\d+)_", n)[1] for n in registered.QUERIES if n != "pipeline"}
    assert numbers == {str(i) for i in range(1, 11)} and len(corpus_pipeline.STAGES) == 5
