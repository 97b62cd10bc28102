import random
from collections import Counter

import numpy as np

import corpus_pipeline as C
from pagewright.llm import suffix_dedup as S
from pagewright.session import table


def brute(texts, words=51):
    """What is left of each text without the bytes of repeated windows of words or of 400 bytes."""
    raws = [(t or "").encode() for t in texts]
    runs = lambda p, n: [p[i : i + n] for i in range(len(p) - n + 1)]
    split = [[w.decode("utf-8", "surrogateescape") for w in r.split()] for r in raws]
    seen = Counter(hash(tuple(w)) for p in split for w in runs(p, words))
    held = Counter(hash(w) for r in raws for w in runs(r, S.LENGTH))
    out = []
    for r, p in zip(raws, split, strict=True):
        gone = np.zeros(len(r), bool)
        first, last = S.word_spans(r)
        for i, w in enumerate(runs(p, words)):
            if seen[hash(tuple(w))] > 1:
                gone[first[i] : last[i + words - 1]] = True
        for i, w in enumerate(runs(r, S.LENGTH)):
            if held[hash(w)] > 1:
                gone[i : i + S.LENGTH] = True
        out.append(np.frombuffer(r, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


def planted():
    rnd = random.Random(7)
    words = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(n))
    short, edge, less, long = words(54), words(51), words(50), "".join(rnd.choice("xyz") for _ in range(500))
    texts = [words(rnd.randint(0, 60)) + " " + p + " " + words(rnd.randint(0, 60)) for p in (short, edge, less, long) for _ in range(4)]
    return [*texts, short.replace(" ", "\n\t"), words(9) + " " + short[40:] + " " + words(9), words(3), "", None, "ab " * 300]


def test_passages_of_over_fifty_words(spark):
    texts = planted()
    assert S.word_spans(b" a\n bc ")[0].tolist() == [1, 4] and S.word_spans(b" a\n bc ")[1].tolist() == [2, 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id: r.text or "" for r in C.repeated_strings(spark, docs, "").collect()}
    assert [kept[i] for i in range(len(texts))] == brute(texts)


def test_stage_on_sample_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    kept = sorted((r.doc_id, r.text or "") for r in C.repeated_strings(spark, docs, "").collect())
    rows = docs.orderBy("doc_id").collect()
    assert kept == list(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))
