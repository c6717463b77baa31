"""Compiled encoders over the public vocabulary files, for operators that need ids only."""

from __future__ import annotations

import numpy as np

from fleetlens.llm.bpe import Vocabulary


class ByteLevel:
    """Byte-level BPE by a tokenizers file: the ids of its own library, from a faster one that gives the same."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        v = Vocabulary(path)
        self.size = 1 + max(v.bytes)
        self.bytes = [v.bytes.get(i, b"") for i in range(self.size)]
        self.machine = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)
        self.special = set(v.special)

    def ids(self, text: str) -> np.ndarray:
        """Ids of the text; special tokens inside it count as such."""
        return self.machine.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())

    def plain_ids(self, text: str) -> np.ndarray:
        """Ids of the text; special tokens inside it are plain text."""
        return self.machine.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


class Pieces:
    """A sentencepiece model with the bytes that each of its pieces stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.machine = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.machine.get_piece_size()
        self.bytes = [self._bytes(self.machine.id_to_piece(i), self.machine.is_byte(i)) for i in range(self.size)]

    @staticmethod
    def _bytes(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.machine.encode(texts, num_threads=1)
