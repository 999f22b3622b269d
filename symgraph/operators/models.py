"""Models behind protocols: embedders, synthesizers, rerankers. Stubs are deterministic; HTTP models speak to
a local server and are used inside workers, in batches."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.text import RERANK_CHARS, clean_description

#: Texts sent to an embedder at once.
BATCH = 32


class ModelError(Exception):
    pass


class Embedder(Protocol):
    identity: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Synthesizer(Protocol):
    def synthesize(self, prompt: str) -> str: ...


class Reranker(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[float | None]: ...


class HashEmbedder:
    """Sums of pseudo-random directions of a text's words, scaled to length 1: texts that share words are near."""

    def __init__(self, dimension: int = 64, identity: str = "stub/words"):
        self.identity, self.dimension = identity, dimension

    def _word(self, w: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(w.encode("utf-8", "replace")).digest()[:8], "little")
        return np.random.default_rng(seed).standard_normal(self.dimension)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = sum((self._word(w) for w in (t or "").lower().split()), np.zeros(self.dimension))
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


class FirstLineSynthesizer:
    """Says the signature line of the prompt again."""

    def synthesize(self, prompt: str) -> str:
        line = next((x for x in prompt.split("\n") if x.startswith("Signature: ")), "")
        return f'Description: "{line[11:]}"' if line else ""


class OverlapReranker:
    """The share of the query's words in the document; no opinion on an empty query."""

    def rerank(self, query: str, documents: list[str]) -> list[float | None]:
        q = set((query or "").lower().split())
        return [len(q & set((d or "").lower().split())) / len(q) if q else None for d in documents]


def _post(url: str, body: dict, seconds: float) -> dict:
    req = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(req, timeout=seconds) as r:
        return json.loads(r.read())


class HttpEmbedder:
    def __init__(self, endpoint: str, model: str, dimension: int):
        self.endpoint, self.model, self.dimension, self.identity = endpoint.rstrip("/"), model, dimension, f"ollama/{model}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = _post(f"{self.endpoint}/api/embed", {"model": self.model, "input": texts}, 60)["embeddings"]
        if len(got) != len(texts) or len(got[0]) != self.dimension:
            raise ModelError(f"{self.identity}: {len(got)} vectors of {len(got[0]) if got else 0} for {len(texts)} texts of {self.dimension}")
        return got


class HttpSynthesizer:
    def __init__(self, endpoint: str, model: str):
        self.endpoint, self.model = endpoint.rstrip("/"), model

    def synthesize(self, prompt: str) -> str:
        return _post(f"{self.endpoint}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0.2}}, 180)["response"]


class HttpReranker:
    """Yes or no per document, asked side by side and answered in the order of the documents; a call that fails is
    no opinion, and it is an error only if all fail."""

    def __init__(self, endpoint: str, model: str, concurrency: int = 4):
        self.endpoint, self.model, self.concurrency = endpoint.rstrip("/"), model, concurrency

    def _one(self, query: str, document: str) -> float | None:
        prompt = f"Query: {query}\nDocument: {(document or '')[:RERANK_CHARS]}\nRelevant (yes/no):"
        try:
            word = _post(f"{self.endpoint}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0.0}}, 5)["response"].split()
        except (OSError, ValueError, KeyError):
            return None
        w = "".join(c for c in word[0] if c.isalnum()).lower() if word else ""
        return {"yes": 1.0, "no": 0.0}.get(w)

    def rerank(self, query: str, documents: list[str]) -> list[float | None]:
        if not documents:
            return []
        with ThreadPoolExecutor(self.concurrency) as pool:
            out = list(pool.map(lambda d: self._one(query, d), documents))
        if all(x is None for x in out):
            raise ModelError("the reranker has no opinion on any document")
        return out


def embed_column(df: DataFrame, embedder: Embedder, text: str, out: str = "embedding") -> DataFrame:
    """Adds the embedding of a text column; null texts give null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got: list = [None] * len(s)
            at = [i for i, t in enumerate(s) if t is not None]
            for i in range(0, len(at), BATCH):
                part = at[i : i + BATCH]
                vectors = embedder.embed([s.iloc[j] for j in part])
                if len(vectors) != len(part):
                    raise ModelError(f"{len(vectors)} vectors for {len(part)} texts")
                for j, v in zip(part, vectors, strict=True):
                    got[j] = v
            yield pd.Series(got)

    return df.withColumn(out, run(F.col(text)))


def rerank_column(df: DataFrame, reranker: Reranker, query: str, document: str, out: str = "rerank") -> DataFrame:
    """Adds the reranker's opinion on each document, null where it has none or fails. df is a bounded list of
    candidates; it is asked in one piece, so that a reranker that fails on all of them is seen to."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            try:
                yield pd.Series(reranker.rerank(query, [d or "" for d in s]), dtype="float64")
            except (ModelError, OSError):
                yield pd.Series([None] * len(s), dtype="float64")

    return df.coalesce(1).withColumn(out, run(F.col(document)))


def synthesize(df: DataFrame, synthesizer: Synthesizer, prompt: str = "prompt") -> DataFrame:
    """Adds synthesized_description and status (synthesized, skipped, failed): rows with has_description are skipped;
    an error or an empty answer fails that row alone."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for p in s:
                try:
                    out.append(synthesizer.synthesize(p) if p is not None else None)
                except Exception:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    todo = F.when(~F.col("has_description"), F.col(prompt))
    answered = df.withColumn("__a", clean_description(run(todo)))
    ok = F.coalesce(F.col("__a"), F.lit("")) != ""
    return answered.withColumn("status", F.when(F.col("has_description"), "skipped").when(ok, "synthesized").otherwise("failed")).withColumn("synthesized_description", F.when(ok, F.col("__a"))).drop("__a")
