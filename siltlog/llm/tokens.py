"""Public byte-level vocabularies, loaded once per Python process from a path that is a parameter."""

from __future__ import annotations

import base64
import functools
import json

#: What the two files of the 50k vocabulary call the end of a document.
END_OF_TEXT = "<|endoftext|>"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a .tiktoken file or from the vocabulary of a byte-level .json file."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(path) as file:
        spec = json.load(file)
    special = {x["content"] for x in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    return {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}


@functools.lru_cache(4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Runs of white space from this many characters on are encoded apart: the rank encoder's pattern keeps a step of
#: backtracking for each character of a run, and gives up at about a million.
LONG_RUN = 50_000


@functools.lru_cache(1)
def _long_runs():
    import regex

    return regex.compile(rf"(?<!\s)\s{{{LONG_RUN},}}").finditer


def encode_ranks(path: str, text: str):
    """The ids of a text by the rank encoder as a uint32 array, special tokens' strings being ordinary text. A long run
    of white space is a match of its own but for a last character that a non-space follows, which may begin the next match."""
    import numpy as np

    known, done, out = encoding(path), 0, []
    if len(text) >= LONG_RUN:
        for run in _long_runs()(text):
            stop = run.end() - (run.end() < len(text))
            out.append(known.encode_to_numpy(text[done : run.start()], disallowed_special=()))
            out.append(np.array(known._core_bpe.encode_single_piece(text[run.start() : stop].encode()), np.uint32))
            done = stop
    rest = known.encode_to_numpy(text[done:] if done else text, disallowed_special=())
    return np.concatenate([*out, rest]) if out else rest


def encode(path: str, text: str):
    """The ids of a .json vocabulary as a uint32 array. The rank encoder gives the same ids several times faster;
    a text with a special token's string, which only the file's own library treats apart, goes to that library."""
    import numpy as np

    if END_OF_TEXT in text:
        return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return encode_ranks(path, text)
