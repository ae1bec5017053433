"""The stages one after the other, each against a plain version on its own input."""

from __future__ import annotations

import base64
import re
from collections import Counter

import pytest

import corpus_pipeline
from corpus import FOLDER, base_measures, near_classes, words
from sondera.llm import curriculum_mix, packing
from sondera.llm.common import written_order


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(results):
    for df in results[:-1]:
        assert df.dtypes == results[0].dtypes


def test_quality(results):
    before, after = (sorted((r.doc_id, r.text) for r in df.collect()) for df in results[:2])
    # with 200 documents no line is above the limit
    assert after == [(i, t) for i, t in before if not base_measures(t)[-1]]


def test_near_duplicates(results):
    before = sorted((r.doc_id, r.text) for r in results[1].collect())
    least, _ = near_classes([t for _, t in before])
    assert sorted(r.doc_id for r in results[2].collect()) == sorted({before[i][0] for i in least})


def test_decontamination(results, spark):
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = {r.doc_id: norm(r.text) for r in results[2].collect()}
    gone = {i for i, t in before.items() if any(f" {x} " in f" {t} " for x in items)}
    assert {r.doc_id for r in results[3].collect()} == set(before) - gone
    assert gone


def test_mix(results):
    mixed = {r.doc_id: r.copies for r in curriculum_mix.mix(results[3]).collect()}
    assert Counter(r.doc_id for r in results[4].collect()) == Counter({i: n for i, n in mixed.items() if n})
    total = sum(len(words(r.text)) for r in results[3].collect())
    assert abs(sum(len(words(r.text)) for r in results[4].collect()) - total) < 0.1 * total


def test_packed(results):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in results[4].collect():
        want[r.doc_id] += len(encoder.encode_ordinary(r.text))
    got = Counter()
    for r in results[5].collect():
        for a, b, doc in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids):
            got[doc] += b - a
    assert got == want


def test_packed_rows_follow_the_mix(results, spark, tmp_path):
    """The mix's files hold its order, and no shard has a document from behind the next shard's."""
    mixed = curriculum_mix.mix(results[3]).collect()
    order = [i for _, i in sorted((p, r.doc_id) for r in mixed for p in r.positions)]
    # small shards: one stage with other parameters, on the same files
    import public_tokenizers as P

    placed = results[4].select("doc_id", "text", *written_order())
    read = placed.orderBy("_part", "_file", "_at").collect()
    assert [r.doc_id for r in read] == order
    packed = packing.pack_tokens(
        placed, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, shard_bytes=20_000, order=("_part", "_file", "_at")
    )
    got, at = packed.collect(), 0
    assert [r.shard for r in got] == sorted(r.shard for r in got) and len({r.shard for r in got}) > 10
    texts = {r.doc_id: r.text for r in read}
    for shard in sorted({r.shard for r in got}):
        own = Counter(d for r in got if r.shard == shard for d, o in zip(r.doc_ids, r.offsets) if o == 0)
        n = sum(own.values())
        here = [i for i in order if texts[i]][at : at + n]
        assert own == Counter(here)
        at += n
    assert at == len([i for i in order if texts[i]])


def test_odd_rows(spark, tmp_path):
    """Empty tables, NULLs in any column, repeated rows and clashing names pass through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _position double, kept int"
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose, "en", "a", 5, 0.5, 1), (1, prose, "en", "a", 5, 0.5, 1), (None, prose, None, None, None, None, None)]
    rows += [(2, None, None, "b", 0, 0.1, 0), (3, "", "en", "b", 0, 0.2, 1), (4, prose.replace("word1 ", "") + " tail" * 3, None, "b", 1, 0.0, 1)]
    rows += [(None, " ".join(f"other{i}" for i in range(40)), "de", None, 2, 0.0, 1)]
    for name, table in (("none", []), ("odd", rows)):
        df = spark.createDataFrame(table, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, FOLDER)
            assert i == 4 or out.columns == df.columns
            path = str(tmp_path / f"{name}{i}")
            out.write.parquet(path)
            df = spark.read.parquet(path)
            if name == "odd" and i == 1:
                # the copies are one class, whatever their ids
                assert df.filter(df.text == prose).count() == 1 and df.filter("text LIKE 'other%'").count() == 1
        assert (df.count() > 0) == (name == "odd")


def test_run(results, spark):
    assert corpus_pipeline.run(spark, FOLDER).count() == results[5].count()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
