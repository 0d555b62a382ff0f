"""What the n-gram model sends between its stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm


@pytest.mark.parametrize("buckets", [1, 5])
def test_word_hashes_are_sent_as_marks_on_the_keys(spark, buckets):
    rng = np.random.default_rng(1)
    words = [f"w{n}" for n in rng.permutation(20_000)]
    texts = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").coalesce(1)
    sent = texts.mapInArrow(lm._pack(3, buckets), lm.SENT)
    binary = [f.name for f in sent.schema if f.dataType.simpleString() == "binary"]
    size = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in binary)
    ranks = F.coalesce(F.aggregate("words", F.lit(0), lambda n, w: n + F.octet_length(w)), F.lit(0))
    # 60,000 n-grams at some 6.3 bytes, and 20,000 indexes; the words' hashes again would be 128,000 bytes.
    assert sent.agg(F.sum(size + ranks)).first()[0] < 490_000
    scored = lm.score_documents(texts, order=3, partition_words=20_000 // buckets).first()
    # Each word occurs once: its n-grams are rarer than the least count, so it is scored alone, twice backed off.
    first, later = np.log(0.4), 2 * np.log(0.4)
    assert scored.n_words == 20_000
    assert scored.log_score == pytest.approx(20_000 * np.log(1 / 20_000) + first + 19_999 * later)
