"""What may be plugged in: embedders and text generators. The defaults need no network and are deterministic."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Anything that turns texts into vectors of one length."""

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


class TextGenerator(Protocol):
    """Anything that answers a prompt."""

    def generate(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Signed hashes of words and word pairs, scaled to unit length; empty text gives the zero vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            ws = re.findall(r"\w+", (t or "").lower())
            for w, c in Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]).items():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.dim] += (1 + np.log(c)) * (1 if h >> 63 else -1)
        norm = np.linalg.norm(out, axis=1)
        return (out / np.where(norm > 0, norm, 1)[:, None]).tolist()


class ExtractiveGenerator:
    """Answers with the sentences of the prompt that hold its most frequent long words."""

    def __init__(self, sentences: int = 3) -> None:
        self.sentences = sentences

    def generate(self, prompt: str) -> str:
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", prompt or "") if s.strip()]
        freq = Counter(w for s in parts for w in set(re.findall(r"\w{5,}", s.lower())))
        best = sorted(range(len(parts)), key=lambda i: (-sum(freq[w] for w in set(re.findall(r"\w{5,}", parts[i].lower()))) / (len(parts[i]) + 40), i))
        return " ".join(parts[i] for i in sorted(best[: self.sentences]))


def last_token_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of the last real token of each row, for padding on either side."""
    if mask[:, -1].all():
        return hidden[:, -1]
    last = mask.shape[1] - 1 - np.argmax(mask[:, ::-1], axis=1)
    return hidden[np.arange(len(hidden)), last]


def unpack_embedding(answer: dict) -> list[list[float]]:
    """The vectors of a service's answer, which names one or several."""
    if answer.get("embeddings"):
        return [list(e["values"]) for e in answer["embeddings"]]
    if answer.get("embedding"):
        return [list(answer["embedding"]["values"])]
    raise ValueError("the answer holds no embedding")


class LocalModelEmbedder:
    """A transformer from a folder: texts are cut at `max_tokens`, padded at the left, pooled at their last token, scaled to unit length.

    The folder holds tokenizer.json and model.onnx with the inputs input_ids and attention_mask and the hidden states
    as first output. `run` (ids, mask) -> hidden states stands in for the model's session where another runtime is
    used. The model is loaded in each worker at its first batch.
    """

    def __init__(self, folder: str, max_tokens: int = 8192, run: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, encode: Callable[[str], list[int]] | None = None, pad: int = 0) -> None:
        self.folder, self.max_tokens, self.run, self.encode, self.pad = folder, max_tokens, run, encode, pad

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _load(self) -> None:
        if "_run" in self.__dict__:
            return
        self._run, self._encode = self.run, self.encode
        if self._encode is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            self._encode = lambda text: t.encode(text).ids
        if self._run is None:
            import onnxruntime

            session = onnxruntime.InferenceSession(f"{self.folder}/model.onnx", providers=["CPUExecutionProvider"])
            self._run = lambda ids, mask: session.run(None, {"input_ids": ids, "attention_mask": mask})[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        self._load()
        rows = [self._encode(t)[: self.max_tokens] or [self.pad] for t in texts]
        width = max(map(len, rows))
        ids, mask = np.full((len(rows), width), self.pad, np.int64), np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            ids[i, width - len(r) :], mask[i, width - len(r) :] = r, 1
        v = last_token_pool(np.asarray(self._run(ids, mask), np.float64), mask)
        norm = np.linalg.norm(v, axis=1)
        return (v / np.where(norm > 0, norm, 1)[:, None]).tolist()


class ServiceEmbedder:
    """A remote service: `call` takes texts and gives its answer as an object; another number of vectors than texts is an error."""

    def __init__(self, call: Callable[[list[str]], dict]) -> None:
        self.call = call

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        got = unpack_embedding(self.call(list(texts)))
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors came for {len(texts)} texts")
        return got


def embed(df: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding", batch: int = 256) -> DataFrame:
    """`df` with the vector of its text, null text as empty; texts go to the embedder in batches."""
    schema = df.sparkSession.createDataFrame([], df.drop(out_col).schema).withColumn(out_col, F.lit(None).cast("array<float>")).schema
    names = [c for c in schema.names if c != out_col]

    def run(it):
        for pdf in it:
            texts = [t or "" for t in pdf[text_col]]
            got: list[list[float]] = []
            for a in range(0, len(texts), batch):
                part = embedder.embed_batch(texts[a : a + batch])
                if len(part) != len(texts[a : a + batch]):
                    raise ValueError("the embedder gave another number of vectors than texts")
                got += part
            yield pd.DataFrame({**{n: pdf[n] for n in names}, out_col: pd.Series(got, index=pdf.index)})

    return df.mapInPandas(run, schema)


def generated(prompt: Column | str, generator: TextGenerator) -> Column:
    """The generator's answer to a prompt; empty for a blank one, without a call."""
    call = F.pandas_udf(lambda s: s.map(lambda p: generator.generate(p) if p and p.strip() else ""), "string")
    return call(prompt)
