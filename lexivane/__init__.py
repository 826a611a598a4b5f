"""lexivane: syllable-level lexical retrieval and text analytics on Spark DataFrames."""

__all__ = ["LexicalEngine"]


def __getattr__(name):
    if name == "LexicalEngine":
        from lexivane.plans.engine import LexicalEngine

        return LexicalEngine
    raise AttributeError(name)
