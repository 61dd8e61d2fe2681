from types import SimpleNamespace

import pytest

from placeshare.plans.jobs import written_all
from placeshare.plans.pipeline import golden_corpus
from placeshare.plans.registry import build_metrics
from placeshare.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def golden(spark):
    """The hand-made corpus with its metrics written once."""
    corpus = golden_corpus(spark)
    metrics = written_all(spark, build_metrics(corpus.inputs, corpus.definition))
    return SimpleNamespace(
        corpus=corpus, inputs=corpus.inputs, d=corpus.definition, metrics=metrics,
        reference=corpus.reference, expected=corpus.expected,
    )
