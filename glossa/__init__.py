"""Spark-native text governance, and operators of training-data pipelines in a subpackage of its own."""

from glossa.sources.profiles import Profile, load_profile, read_profile

__version__ = "0.2.0"
__all__ = ["Profile", "analyze", "compare", "judge", "load_profile", "read_profile"]


def analyze(docs, profile: Profile | None = None):
    """A table (doc_id, text) to its findings with places; see ``glossa.operators.analysis``."""
    from glossa.operators import analysis

    return analysis.findings(docs, profile or load_profile())


def compare(pairs):
    """A table (pair_id, source, candidate) to dispositions of meaning with what is missing and added."""
    from glossa.operators import claims

    return claims.compare_texts(pairs)


def judge(pairs, profile: Profile | None = None, target_grade: float | None = None):
    """A table (pair_id, source, candidate) to verdicts with reasons."""
    from glossa.operators import judging

    return judging.judge(pairs, profile or load_profile(), target_grade)
