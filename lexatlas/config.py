"""Run parameters from INI files, with ``${section:name}`` references."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field


def parse(text: str) -> dict[str, dict[str, str]]:
    """section -> name -> value."""
    parser = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation())
    parser.read_string(text)
    return {s: dict(parser.items(s)) for s in parser.sections()}


def load(spark, path: str) -> dict[str, dict[str, str]]:
    """Sections of a file that Spark can read."""
    return parse(spark.read.text(path, wholetext=True).first().value)


def numbers(value: str) -> list[int]:
    return [int(x) for x in value.split(",")]


@dataclass(frozen=True)
class SensesRun:
    """Parameters of sense induction over a corpus."""

    conll_data_path: str
    ner_contexts_output: str
    nes_senses_output_stem: str
    language: str
    tokens_to_be_processed: int
    max_k: int
    ms: list[int] = field(default_factory=list)
    linker: str = "dummy"

    @classmethod
    def of(cls, sections: dict[str, dict[str, str]]) -> SensesRun:
        w = sections["wikiner"]
        linker = sections.get("entity_linking", {}).get("linker", "dummy")
        if linker not in ("dummy", "wikidata"):
            raise ValueError(f"linker {linker} is not known")
        return cls(w["conll_data_path"], w["ner_contexts_output"], w["nes_senses_output_stem"], w["language"], int(w["tokens_to_be_processed"]), int(w["max_k"]), numbers(w["ms"]), linker)


@dataclass(frozen=True)
class TypesRun:
    """Parameters of class induction over a file of senses."""

    ners_predictions_path: str
    new_types_output_folder: str
    language: str
    ks: list[int]
    ths_type_descriptors: list[int]

    @classmethod
    def of(cls, sections: dict[str, dict[str, str]]) -> TypesRun:
        w = sections["wikiner"]
        return cls(w["ners_predictions_path"], w["new_types_output_folder"], w["language"], numbers(w["ks"]), numbers(w["ths_type_descriptors"]))
