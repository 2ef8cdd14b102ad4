"""Token ids of whole texts from a tokenizer file."""

from __future__ import annotations

import json
from functools import cache

import numpy as np

END = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself if it prints, else as the next free character from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def ranks_suffice(path: str) -> bool:
    """Whether merging the adjacent pair whose joint token has the least id, again and again, gives the ids that the file's own model gives to every word.

    It does if the file asks for nothing but byte-level merges, the merges make tokens of ascending ids, all above those of the bytes, and the model makes each token from its own characters. For then,
    as long as both have merged alike, two adjacent tokens whose join is in the vocabulary are the last two that the model has before it makes that join from its characters (inside them it has
    merged as it does for them alone), so they are a pair of its merges, and the pair of least id is its next merge.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or told.get("truncation") or told.get("padding"):
        return False
    vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get("".join(m)) for m in pairs]
    single = [vocab.get(c) for c in _byte_of_char()]
    if None in made or None in single or len(set(made) | set(single)) != len(vocab) or made != sorted(set(made)) or (made and max(single) > made[0]):
        return False
    alone = Tokenizer.from_file(path)
    alone.pre_tokenizer = None
    tokens = list(vocab)
    return all(e.ids == [vocab[t]] for k in range(0, len(tokens), 4096) for t, e in zip(tokens[k : k + 4096], alone.encode_batch_fast(tokens[k : k + 4096], add_special_tokens=False), strict=True))


class Encoder:
    """Ids of texts, the same as the tokenizers library gives with add_special_tokens=False and its other settings as they are.

    The vocabulary is the tokenizer file's, read by the tokenizers library. Where ranks_suffice() shows that the ids alone decide every merge, a faster merge loop
    over them serves for the bulk (measured: 11 against 2.9 MB a CPU second); words are split by the same pattern, which a test compares at every character. A text that holds a token which
    the file adds to its vocabulary, and every text with another file, goes through the library. Which of the two a text takes depends on the file and the text alone.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        byte_of = _byte_of_char()
        vocab = self.slow.get_vocab(with_added_tokens=False)
        special = self.added = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        self.fast = None
        if ranks_suffice(path):
            ranks = {bytes(byte_of[c] for c in s): i for s, i in vocab.items() if s not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if self.slow.get_vocab_size() <= 1 << 16 else "<u4")

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, then END; null is like empty."""
        return [np.append(self.ids(text or ""), np.uint32(END)) for text in texts]


@cache
def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    return Encoder(path)
