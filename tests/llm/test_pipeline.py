"""The pipeline against a version that looks at one text, or one pair, at a time."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from wayfare.llm import pii, quality
from wayfare.llm.queries import PII_KEY

from .test_llm import WORD, base_figures, slow_components, slow_leak, slow_print, slow_shingles, stripped


def test_stages_and_contract(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pseudonyms", "encoding"] and corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).dtypes == docs.dtypes


def slow_quality(text, lang, model):
    n_words, _, _, _, repeat = base_figures(text)
    if n_words < 20 or 100 * repeat > 30 * n_words:
        return False
    words = WORD.findall(text)
    ids = [i for w in words for i in model.encode(w)]
    low, high, most_bytes, entropy_floor, least_floor = quality.BANDS[lang]
    shares, bits = [c / len(ids) for c in Counter(ids).values()], math.log2(len(ids))
    fine = low <= sum(map(len, words)) / len(ids) <= high and sum(map(model.is_byte, ids)) / len(ids) <= most_bytes
    return fine and -sum(x * math.log2(x) for x in shares) >= min(entropy_floor, 0.70 * bits) and -math.log2(max(shares)) >= min(least_floor, 0.45 * bits)


@pytest.fixture(scope="module")
def result(spark, data):
    return {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}


def test_pipeline_equals_the_slow_version(spark, data, result):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = [stripped(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    kept = sorted(i for i, r in docs.items() if slow_quality(r.text, r.lang, model))
    sets, prints = [slow_shingles(docs[i].text) for i in kept], [slow_print(docs[i].text) for i in kept]
    head = slow_components(prints, kept)
    changed = True
    while changed:  # join pairs of a similarity of 0.8 or more to the SimHash components
        changed = False
        for n, a in enumerate(kept):
            for m in range(n):
                b = kept[m]
                same = len(sets[n] & sets[m])
                if head[a] != head[b] and same >= 0.8 * (len(sets[n]) + len(sets[m]) - same):
                    low, high = sorted((head[a], head[b]))
                    head = {i: low if h == high else h for i, h in head.items()}
                    changed = True
    single = [i for i in kept if head[i] == i]
    clean = [i for i in single if not any(slow_leak(docs[i].text, x) for x in items)]
    assert sorted(result) == clean and 0 < len(clean) < len(docs)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    hide, public = pii.Pseudonyms(PII_KEY.encode()), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in clean:
        text = hide.text(docs[i].text, {})
        assert not re.search(r"\S+@\S+", docs[i].text) or text != docs[i].text
        ids = public.encode_ordinary(text)
        coded = np.array(ids, "<u4").tobytes()
        assert result[i].ids == ids and result[i].ids_sha256 == hashlib.sha256(coded).hexdigest() and result[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, data, tmp_path, result):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = docs.where(F.col("doc_id") == min(result)).first().text
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 30, None, None, None)] + [(7, good, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, n in ((odd, 2), (docs.where("false"), 0)):
        out = frame
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, out, data).write.parquet(f"{tmp_path}/{n}-{k}")
            out = spark.read.parquet(f"{tmp_path}/{n}-{k}")
        assert out.count() == n and out.where(F.col("doc_id") != 7).count() == 0


def test_stages_keep_columns_of_clashing_names(spark, data, result):
    """Columns with the names that stages use inside come out as they went in, and change no decision."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 40")
    extra = {c: F.lit(i) for i, c in enumerate(("key", "fp", "sig", "bands", "node", "head", "component", "component_id", "id", "doc", "size", "item_id", "score", "kept", "word", "ids"))}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, docs, data), stage(spark, docs.withColumns(extra), data)
        assert wide.columns == [*docs.columns, *extra]
        rows = wide.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
        assert all(tuple(r)[len(docs.columns) :] == tuple(range(len(extra))) for r in rows)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.withColumns(extra), data).columns == last(spark, docs, data).columns
