"""Measurements that the README states: python -m docketry.llm.measure abuse | near ROWS | tokens"""

from __future__ import annotations

import pickle
import random
import resource
import sys
import time

from docketry.llm import abuse, near_duplicates


def abuse_peak() -> None:
    """Training at both bounds of the sample, on random words, which share as little as words can."""
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 10))) for _ in range(60_000)]
    each = abuse.LABELLED_CHARS // abuse.LABELLED
    texts = []
    for _ in range(abuse.LABELLED):
        words, n = [], 0
        while n < each:
            words.append(r.choice(vocabulary) + ("." if r.random() < 0.08 else ""))
            n += len(words[-1]) + 1
        texts.append(" ".join(words))
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    model = abuse.train(list(range(len(texts))), texts, [i % 6 == 0 for i in range(len(texts))])
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    print({"texts": len(texts), "chars": sum(map(len, texts)), "seconds": round(time.time() - began, 1), "mb_before": round(before), "mb_peak": round(peak), "mb_model": round(len(pickle.dumps(model)) / 1e6, 1)})


def near(rows: int) -> None:
    """Groups of so many texts, made from those of check_l by changing words."""
    from pyspark.sql import functions as F

    from docketry.session import local_session

    spark = local_session()
    docs = spark.read.parquet("/root/testdata/check_l/court_opinions.parquet").select("opinion_id", "full_text").filter("full_text is not null")
    copies = -(-rows // docs.count())
    # copy k of a text has another ending on every word but a tenth, so that copies are no near-duplicates of each other
    words = F.transform(F.split("full_text", " "), lambda w: F.when((F.col("k") == 0) | (F.pmod(F.xxhash64(w, "k"), F.lit(10)) == 0), w).otherwise(F.concat(w, F.col("k").cast("string"))))
    docs = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(F.concat_ws("-", "opinion_id", "k").alias("id"), F.array_join(words, " ").alias("text")).limit(rows)
    began = time.time()
    out = near_duplicates.membership(docs, "id", "text", near_duplicates.Likeness(run=3, share=(1, 2)))
    n = out.groupBy("group_id").count().filter("count > 1").count()
    print({"rows": rows, "groups_of_several": n, "seconds": round(time.time() - began, 1)})


if __name__ == "__main__":
    abuse_peak() if sys.argv[1] == "abuse" else near(int(sys.argv[2]))
