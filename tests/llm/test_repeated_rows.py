"""Rows repeated in id and text, very many of them: one text to the suffix arrays, the right result for every row."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from chronofold.llm import suffix_dedup


def test_ten_thousand_identical_rows(spark):
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words, n))
    shared = prose(70)
    hot, other, clean = prose(40) + shared + prose(40), prose(30) + shared[20:] + prose(30), prose(120)
    rows = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(hot).alias("text"))
    docs = rows.union(spark.createDataFrame([(8, other), (9, clean)], "doc_id long, text string")).repartition(8)
    found = suffix_dedup.deduplicate(docs).groupBy("doc_id", "n_removed", "kept_sha256").count().collect()
    same = len(shared) - 20  # of the other one, what stands in the hot one too; the bytes around may be equal by chance
    by = {x["doc_id"]: x for x in found}
    assert len(found) == 3 and by[7]["count"] == 10_000 and by[7]["n_removed"] == len(hot) and by[7]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert same <= by[8]["n_removed"] <= same + 4 and by[9]["n_removed"] == 0

    one = suffix_dedup._texts(docs).where("key = 7").limit(1).select(
        "key", "check", F.lit(300).cast("long").alias("at"), F.lit(0).alias("low"), F.lit(5).alias("high"), F.lit(1).cast("long").alias("core"), F.lit(True).alias("copies"), F.lit(False).alias("large")
    )
    assert suffix_dedup._stretches(docs, one, 400).count() == 1  # not one for each of the rows
