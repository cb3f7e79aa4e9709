"""Public tokenizers by name. Their files lie outside the repository; the folder is a parameter."""

from __future__ import annotations

import base64
import functools
import importlib.util
import os

#: Where the vocabulary files are; every operator takes another folder as an argument.
TOKENIZER_DIR = os.environ.get("EMBERLINE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"


def split_pattern(folder: str = TOKENIZER_DIR) -> str:
    """The pattern by which the rank files' tokenizers split a text, as their folder states it."""
    spec = importlib.util.spec_from_file_location("tokenizer_folder", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@functools.lru_cache(maxsize=4)
def byte_bpe(name: str = DEFAULT, folder: str = TOKENIZER_DIR):
    """A tiktoken encoding of a rank file, without special tokens; loaded once per worker process."""
    import tiktoken

    ranks = {}
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(name, pat_str=split_pattern(folder), mergeable_ranks=ranks, special_tokens={})


def clean(text: str) -> str:
    """The text as UTF-8 can hold it: lone surrogates become the replacement character."""
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def token_counts(texts, name: str = DEFAULT, folder: str = TOKENIZER_DIR) -> list[int]:
    """Tokens of each text; null and empty texts have none.

    Very long texts are handed over whole: the pattern cuts them to words before any merge.
    """
    encode = byte_bpe(name, folder).encode_ordinary
    return [len(encode(clean(t))) if t else 0 for t in texts]
