"""Token ids of whole texts, with the vocabulary of a public tokenizer.

The rank file holds the vocabulary of ``byte_bpe_50k.json`` as bytes and ranks; ids are the same (a test compares
them), and it encodes several times faster. Added tokens are read from the json; callers say whether their strings in
a text are those tokens, as they are to the tokenizers library, or ordinary text. Every token is a string of bytes, so token offsets are running sums.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import tiktoken
import tokenizers

VOCABULARY = "byte_bpe_50k"
CHUNK = 1 << 20


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and each id's number of bytes. The vocabulary's file is found by the installed package."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    sizes = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
    for token, rank in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
        sizes[rank] = len(token)
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), sizes


@lru_cache(maxsize=4)
def library(vocabulary: str, special: bool) -> tokenizers.Tokenizer:
    """The vocabulary in the tokenizers library, which takes added tokens as such unless told otherwise."""
    import public_tokenizers

    made = tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    made.encode_special_tokens = not special
    return made


def ids_of(text: str, vocabulary: str = VOCABULARY, special: bool = False) -> np.ndarray:
    """Ids of a whole text. Strings of added tokens are these tokens if ``special``, or else ordinary text.

    The rank file's pattern gives up on runs of very many blanks; such texts go to the tokenizers library, whose ids are the
    same and which is slower.
    """
    encoder = encoding(vocabulary)[0]
    try:
        ids = encoder.encode(text, allowed_special="all") if special else encoder.encode_ordinary(text)
    except ValueError:
        ids = library(vocabulary, special).encode(text, add_special_tokens=False).ids
    return np.array(ids, np.uint32)
