"""Byte-pair ids of whole texts, without any state that grows in a worker.

Where the i-th merge makes the i-th id, the rank form of the same vocabulary
gives the same ids faster; it takes texts of Latin characters, whose letters and
digits every Unicode version classes alike. All other texts, and those with very
long runs without a break, go through the vocabulary's own tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

#: Runs that the rank form's splitter or merger would take too long for.
_LONG = re.compile(r"\S{2000}|\s{500}")
#: Letters and digits of these blocks are classed alike by every Unicode version.
_LATIN = re.compile("[\x00-\u024f]*+")
#: Fixed value: the splitter of byte-level BPE.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranked(path: str) -> tuple[Callable[[str], list[int]] | None, list[str]]:
    """(the same vocabulary as a rank-based encoder, strings of special tokens).

    Ids are merge ranks when the i-th merge makes the i-th id after the single
    bytes; only then the faster encoder gives the same ids, else it is None.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    vocab = spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges) + len([t for t in special if t in vocab]):
        return None, special
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    import tiktoken

    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, special


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> ids as little-endian uint32 bytes; one encoder per worker process."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def whole(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        fast, special = _ranked(path)

        def encode(text: str) -> bytes:
            if not text:
                return b""
            if fast and _LATIN.fullmatch(text) and not _LONG.search(text) and not any(x in text for x in special):
                return np.array(fast(text), "<u4").tobytes()
            return whole(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]
