"""What fitted operators read, and what they keep of it."""

import itertools
import random
import string

from helpers import make_documents
from pareframe.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_every_strong_feature_stays(spark):
    rnd = random.Random(3)
    words = ["".join(x) for x in itertools.islice(itertools.product(string.ascii_lowercase, repeat=3), 3000)]
    bad, good = words[:1500], words[1500:]
    texts = [(i, " ".join(rnd.sample(kind, len(kind)))) for i, kind in enumerate([bad, good] * 20)]
    model = toxicity.train(make_documents(spark, texts), spark.createDataFrame([(i, 1, 1 - i % 2) for i, _ in texts], LABELS))
    assert set(bad) <= set(model.weights)
    assert not set(good) & set(model.weights)


def test_labels_without_document_take_no_place(spark):
    documents = make_documents(spark, [(i, f"text {i}") for i in range(50)] + [(50, None)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(2000)], LABELS)
    assert toxicity._sample(documents, labels, 40).count() == 40
    assert toxicity._sample(documents, labels, 1000).count() == 50
