"""Token ids of whole texts by a public byte-level vocabulary.

The vocabulary lies in two files, one for each library. `tiktoken` is several times faster and gives the same ids, so
it takes all texts but those that spell a special token, which `tokenizers` reads as that token.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import numpy as np

VOCABULARY = "byte_bpe_50k"
END_OF_TEXT = 2


@functools.cache
def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """text -> ids, without special tokens added. One for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def document_ids(text: str | None, encode: Callable[[str], list[int]], end: int = END_OF_TEXT) -> np.ndarray:
    """Ids of a document with its end token; a null is an empty text."""
    ids = encode(text) if text else []
    ids.append(end)
    return np.array(ids, dtype="<u4")
