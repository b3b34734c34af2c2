"""Model calls as batch-inference jobs.

A model stage is a ``mapInPandas`` over Arrow batches: the client (or model)
is built once per Python worker from a factory, rows are sent in batches, and
a failing row yields an ``error`` value instead of failing the task.  The
engine ships deterministic defaults (pure column expressions) so every stage
runs offline; real models are user-supplied factories.
"""

from __future__ import annotations

import inspect
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.text import tokens

# Retry policy of the chat client.
MAX_ATTEMPTS = 3
RETRY_STATUS = (429, 500, 502, 503, 504)
NO_SOURCES_ANSWER = "No relevant Stack Overflow answers found for this question."


@dataclass(frozen=True)
class CallOptions:
    """M7: what a chat call may be given beside its prompt; None leaves the client's own default."""
    system: str | None = None
    temperature: float | None = None
    max_tokens: int | None = None

    def given(self) -> dict:
        return {k: v for k, v in vars(self).items() if v is not None}


@dataclass(frozen=True)
class Models:
    """The user models of a pipeline run, as factories that run once per task; None keeps the built-in stage.

    ``rewriter``, ``answerer`` and ``judge`` make chat clients (``complete``), ``embedder`` a model with
    ``encode``, ``scorer`` one with ``predict``.  Chat stages have ``in_flight`` calls per task under way."""
    rewriter: Callable[[], object] | None = None
    embedder: Callable[[], object] | None = None
    scorer: Callable[[], object] | None = None
    answerer: Callable[[], object] | None = None
    judge: Callable[[], object] | None = None
    in_flight: int = 1


class ModelCallError(Exception):
    """A failed model call; ``status`` is the HTTP status when there is one,
    ``retryable`` marks timeouts and connection errors."""

    def __init__(self, message: str, status: int | None = None, retryable: bool = False):
        super().__init__(message)
        self.status = status
        self.retryable = retryable or (status in RETRY_STATUS)


def accepted(fn: Callable, args: dict) -> dict:
    """Those of ``args`` that ``fn`` has parameters for."""
    params = inspect.signature(fn).parameters
    if any(p.kind is p.VAR_KEYWORD for p in params.values()):
        return args
    return {k: v for k, v in args.items() if k in params}


class Pace:
    """The back-off that a task's calls share: while one of them waits after a retryable failure, no other begins."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self._clock, self._sleep = clock, sleep
        self._lock = threading.Lock()
        self._until = 0.0

    def hold(self, seconds: float) -> None:
        """No call begins for ``seconds`` from now (or longer, if that was agreed before)."""
        with self._lock:
            self._until = max(self._until, self._clock() + seconds)

    def wait(self) -> None:
        """Sleep until calls may begin; others may prolong the wait meanwhile."""
        while True:
            with self._lock:
                left = self._until - self._clock()
            if left <= 0:
                return
            self._sleep(left)


def call_with_retry(fn: Callable[[], str], max_attempts: int = MAX_ATTEMPTS, base_wait: float = 2.0,
                    sleep: Callable[[float], None] = time.sleep, pace: Pace | None = None):
    """M7: up to ``max_attempts`` tries, waiting ``base_wait * 2**n`` between
    tries of a retryable failure (together with the other calls of ``pace``, if
    given); never after the last try.  Returns (text, error, attempts)."""
    last = None
    for attempt in range(1, max_attempts + 1):
        if pace:
            pace.wait()
        try:
            return fn(), None, attempt
        except ModelCallError as e:  # noqa: PERF203
            last = e
            if not e.retryable:
                return None, f"{e}", attempt
            if attempt < max_attempts:
                (pace.hold if pace else sleep)(base_wait * (2 ** (attempt - 1)))
        except Exception as e:  # noqa: BLE001 -- one bad row must not kill the job
            return None, f"{type(e).__name__}: {e}", attempt
    return None, f"failed after {max_attempts} attempts: {last}", max_attempts


def batch_complete(df: DataFrame, prompt_col: str, client_factory: Callable[[], object],
                   key_cols: list[str], max_attempts: int = MAX_ATTEMPTS,
                   base_wait: float = 2.0, options: CallOptions | None = None, in_flight: int = 1) -> DataFrame:
    """M7: (key..., completion, error, attempts) for every prompt row.

    ``client_factory()`` runs once per batch iterator (per task) and returns an
    object with ``complete(prompt) -> str``, which is given those of the set
    ``options`` that it has parameters for.  A task has at most ``in_flight`` calls under way (the
    client must then be safe to call from several threads), which share one
    back-off; results keep the order of the rows.  A null prompt is sent as ''."""
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in df.schema.fields if f.name in key_cols)
    schema = f"{key_schema}, completion string, error string, attempts int"

    def run(batches):
        client, pace = client_factory(), Pace()
        args = accepted(client.complete, options.given()) if options else {}

        def one(prompt):
            return call_with_retry(lambda: client.complete(prompt or "", **args), max_attempts, base_wait, pace=pace)

        with ThreadPoolExecutor(max_workers=in_flight) as calls:
            for pdf in batches:
                out = pdf[key_cols].copy()
                res = list(calls.map(one, pdf[prompt_col]))
                out["completion"] = [r[0] for r in res]
                out["error"] = [r[1] for r in res]
                out["attempts"] = pd.array([r[2] for r in res], dtype="int32")
                yield out

    return df.select(*key_cols, prompt_col).mapInPandas(run, schema)


class ScriptedClient:
    """A fake chat client for tests and the registered query: the outcome of a
    prompt is fixed by the first hex digits of its md5 (mod 4):
    0 -> answer at once; 1 -> one 503 then an answer; 2 -> 401 (not retried);
    3 -> 503 every time."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    def complete(self, prompt: str) -> str:
        import hashlib
        case = int(hashlib.md5(prompt.encode("utf-8")).hexdigest()[:4], 16) % 4
        n = self.calls.get(prompt, 0) + 1
        self.calls[prompt] = n
        if case == 1 and n == 1 or case == 3:
            raise ModelCallError("HTTP 503", status=503)
        if case == 2:
            raise ModelCallError("HTTP 401", status=401)
        return "answer: " + " ".join(prompt.split()[:5])


# --- deterministic defaults (column expressions) ---------------------------

def default_rewrite(question: Column) -> Column:
    """M3 default: the rewriter's own fallback -- a JSON array of the question."""
    return F.to_json(F.array(question))


def overlap_share(a_tokens: Column, b_tokens: Column) -> Column:
    """|distinct(a) & distinct(b)| / |distinct(a)|, 0 when a is empty."""
    da = F.array_distinct(a_tokens)
    return F.when(F.size(da) > 0, F.size(F.array_intersect(da, F.array_distinct(b_tokens)))
                  .cast("double") / F.size(da).cast("double")).otherwise(F.lit(0.0))


def default_judge(question: Column, answer: Column, has_sources: Column) -> Column:
    """M5 default: judge output as JSON text (parsed later by P19).

    relevance = 1 + floor(4 * share of question words in the answer);
    accuracy = 5 with sources, else 1; completeness = 1 + floor(4 * min(1, words/100))."""
    q = tokens(F.lower(question))
    a = tokens(F.lower(answer))
    rel = F.lit(1) + F.floor(F.lit(4.0) * overlap_share(q, a))
    acc = F.when(has_sources, F.lit(5)).otherwise(F.lit(1))
    comp = F.lit(1) + F.floor(F.lit(4.0) * F.least(F.lit(1.0), F.size(a) / F.lit(100.0)))
    return F.concat(F.lit('{"relevance": '), rel.cast("string"), F.lit(', "accuracy": '),
                    acc.cast("string"), F.lit(', "completeness": '), comp.cast("string"),
                    F.lit(', "reasoning": "overlap stub"}'))


def embed_job(df: DataFrame, key_cols: list[str], text_col: str,
              embedder_factory: Callable[[], object], normalize: bool = True) -> DataFrame:
    """M1/R3 with a user model: (key..., embedding array<float>) per row.

    ``embedder_factory()`` runs once per task and returns an object with
    ``encode(list[str]) -> array (n x d)``; rows go in Arrow batches."""
    import numpy as np
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in df.schema.fields if f.name in key_cols)

    def run(batches):
        model = embedder_factory()
        for pdf in batches:
            vecs = np.asarray(model.encode(pdf[text_col].fillna("").tolist()), dtype=np.float64)
            if normalize and len(vecs):
                norms = np.linalg.norm(vecs, axis=1, keepdims=True)
                vecs = np.divide(vecs, norms, out=np.zeros_like(vecs), where=norms > 0)
            out = pdf[key_cols].copy()
            out["embedding"] = [v.astype(np.float32) for v in vecs]
            yield out

    return df.select(*key_cols, text_col).mapInPandas(
        run, f"{key_schema}, embedding array<float>")


def pair_scorer_job(pairs: DataFrame, key_cols: list[str], query_col: str, text_col: str,
                    scorer_factory: Callable[[], object]) -> DataFrame:
    """M2/R8 with a user model (a cross-encoder): (key..., reranker_score).

    ``scorer_factory()`` runs once per task and returns an object with
    ``predict(list[(query, text)]) -> scores``.  If a batch fails, its rows
    score 0.0 -- the reference's fallback, which keeps the incoming order."""
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in pairs.schema.fields if f.name in key_cols)

    def run(batches):
        model = scorer_factory()
        for pdf in batches:
            out = pdf[key_cols].copy()
            try:
                scores = model.predict(list(zip(pdf[query_col].fillna(""), pdf[text_col].fillna(""))))
                out["reranker_score"] = pd.Series(scores, dtype="float64").to_numpy()
            except Exception:  # noqa: BLE001 -- scorer failure -> fallback scores
                out["reranker_score"] = 0.0
            yield out

    return pairs.select(*key_cols, query_col, text_col).mapInPandas(
        run, f"{key_schema}, reranker_score double")
