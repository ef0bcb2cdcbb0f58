"""Languages by name or code, and what is loaded for them once per worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language code, beginnings of its names, parser model, name of its stop words.
LANGUAGES = (("de", ("de", "ge"), "de_core_news_sm", "german"), ("en", ("en",), "en_core_web_sm", "english"), ("nl", ("nl",), "nl_core_news_sm", "dutch"), ("es", ("es", "sp"), "es_core_news_sm", "spanish"))


def _pick(c: Column, at: int) -> Column:
    out = F.lit(None).cast("string")
    for row in reversed(LANGUAGES):
        begins = F.lit(False)
        for b in row[1]:
            begins = begins | c.startswith(b)
        out = F.when(begins, row[at]).otherwise(out)
    return out


def code(c: Column) -> Column:
    """de, en, nl or es; null for others."""
    return _pick(F.lower(c), 0)


def model_name(c: Column) -> Column:
    return _pick(F.lower(c), 2)


def stopwords_name(c: Column) -> Column:
    return _pick(F.lower(c), 3)


class LazyResources(dict):
    """language -> (loaded model, name of the stop words); a model is loaded when it is first asked for."""

    def __init__(self, load: Callable[[str], object]) -> None:
        super().__init__()
        self.load = load

    def __missing__(self, language: str) -> tuple[object, str]:
        for short, begins, model, stop in LANGUAGES:
            if language.lower().startswith(begins):
                if language != short:
                    return self[short]
                self[short] = (self.load(model), stop)
                return self[short]
        raise KeyError(f"{language}: only {', '.join(x[0] for x in LANGUAGES)} are known")
