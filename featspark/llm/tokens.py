"""Token ids of the public byte-level vocabulary.

The rank file holds the same vocabulary as the JSON file and gives the same ids several times faster.
Texts that spell a special token go to the JSON file's tokenizer, which alone knows those.
"""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Callable

#: The vocabulary's name, its end-of-text id and the spelling of its special token.
TOKENIZER = "byte_bpe_50k"
END_ID = 2
SPECIAL = "<|endoftext|>"


def tokenizer_paths(name: str = TOKENIZER) -> tuple[str, str]:
    """Places of the JSON and rank files on this machine."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def load_encoder(name: str = TOKENIZER) -> Callable[[str], list[int]]:
    """The function from a text to its ids, without special tokens added; made once in a process. Tasks
    get this module's functions by value, so the encoders are kept in the interpreter's own table."""
    kept = sys.__dict__.setdefault("_featspark_encoders", {})
    if name not in kept:
        kept[name] = _make_encoder(name)
    return kept[name]


def _make_encoder(name: str) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    json_path, rank_path = tokenizer_paths(name)
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    slow = None

    def encode(text: str) -> list[int]:
        nonlocal slow
        if SPECIAL not in text:
            return fast(text)
        if slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(json_path)
        return slow.encode(text, add_special_tokens=False).ids

    return encode
