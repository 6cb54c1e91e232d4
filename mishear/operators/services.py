"""What calls models and other services, behind interfaces.

An operator takes a client (any object with the named method that can be sent
to workers), makes the calls that differ, each once, and joins what they give
back. The fakes are deterministic, for tests and dry runs.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mishear.functions import text as t
from mishear.operators import audio, manifest
from mishear.operators.ranking import apply_decisions, reply_decisions


class Transcriber(Protocol):
    def transcribe(self, path: str, language: str | None, prompt: str | None) -> str: ...


class Synthesizer(Protocol):
    """A speech engine: a name, and PCM16 samples for a request."""

    name: str

    def synthesize(self, text: str, voice: str, instruction: str | None, phonemes: str | None) -> tuple[bytes, int]: ...


class Model(Protocol):
    def reply(self, canonical: str, candidates: list[str]) -> str: ...


class Service(Protocol):
    def start(self) -> None: ...
    def ready(self) -> bool: ...
    def stop(self) -> None: ...


# fakes


@dataclass(frozen=True)
class FakeTranscriber:
    """Hears what a table says of a path, else the path's digest; fails on paths with ``fail``."""

    heard: Mapping[str, str] | None = None

    def transcribe(self, path: str, language: str | None, prompt: str | None) -> str:
        if "fail" in path:
            raise OSError(f"no audio at {path}")
        return (self.heard or {}).get(path) or hashlib.sha256(f"{path}|{language}|{prompt}".encode()).hexdigest()[:8]


@dataclass(frozen=True)
class FakeSynthesizer:
    """A tone for each character."""

    name: str = "fake"

    def synthesize(self, text: str, voice: str, instruction: str | None, phonemes: str | None) -> tuple[bytes, int]:
        if not text:
            raise ValueError("no text")
        return b"".join((ord(c) % 1000 * 16).to_bytes(2, "little", signed=True) * 160 for c in text), audio.RATE


@dataclass(frozen=True)
class FakeModel:
    """Drops candidates with a digit."""

    def reply(self, canonical: str, candidates: list[str]) -> str:
        drop = ", ".join(f'{{"word": {c!r}, "reason": "digit"}}'.replace("'", '"') for c in candidates if any(x.isdigit() for x in c))
        return f'```json\n{{"drop": [{drop}], "keep": []}}\n```'


# calls


def called(rows: DataFrame, keys: list[str], call: Callable[..., str], result: str, retries: int = 0, wait: float = 0.0) -> DataFrame:
    """(keys, result, error) of one call for each distinct row of ``keys``; a call that fails is made again ``retries`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in batch[keys].itertuples(index=False):
                value = error = None
                own = [None if isinstance(v, float) and v != v else v for v in values]
                for attempt in range(retries + 1):
                    try:
                        value, error = call(*own), None
                        break
                    except (OSError, ValueError, RuntimeError) as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                        if attempt < retries and wait:
                            time.sleep(min(wait * 2**attempt, 8))
                out.append((*own, value, error))
            yield pd.DataFrame(out, columns=[*keys, result, "error"])

    distinct = rows.select(*keys).distinct()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInPandas(run, f"{kinds}, `{result}` string, error string")


def transcribed(rows: DataFrame, client: Transcriber, fixed: str | None = None, from_manifest: bool = True, prompt: str | None = None, order: str = "seq", reuse: bool = True) -> DataFrame:
    """Manifest rows (order, audio_path, status, language, text) with what was heard: status, text and error in ``asr``, and the comparison.

    Each (audio, language, prompt) is heard once; rows after the first reuse it if ``reuse`` says so, as a sequential
    run does. Rows that are not ready are skipped, those without audio fail.
    """
    language = manifest.language(fixed) if from_manifest or fixed else F.lit(None).cast("string")
    keyed = rows.withColumns({"action": manifest.gate(), "asr_language": language, "asr_prompt": F.lit(prompt).cast("string")})
    keys = ["audio_path", "asr_language", "asr_prompt"]
    heard = called(keyed.where("action = 'transcribe'"), keys, client.transcribe, "heard")
    on = [F.col("a.action") == "transcribe", *(F.col(f"a.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys)]
    joined = keyed.alias("a").join(heard.alias("h"), reduce(lambda x, y: x & y, on), "left").select("a.*", "h.heard", "h.error")
    first = F.row_number().over(Window.partitionBy(*keys, F.col("action")).orderBy(order)) == 1
    ok = F.col("heard").isNotNull()
    status = F.when(F.col("action") != "transcribe", F.col("action")).when(~ok, "error").when(first | F.lit(not reuse), "success").otherwise("reused")
    error = F.when(F.col("action") == "skipped", F.concat(F.lit("status is "), F.coalesce("status", F.lit("missing")))).when(F.col("action") == "error", "no audio path").otherwise(F.col("error"))
    text = t.unwrapped(F.col("heard"))
    asr = F.struct(status.alias("status"), text.alias("text"), error.alias("error"), F.col("asr_language").alias("language"))
    out = joined.withColumn("asr", asr)
    return out.withColumn("comparison", F.when(F.col("asr.text").isNotNull(), t.compare(F.col("text"), F.col("asr.text")))).drop("action", "heard", "error", "asr_language", "asr_prompt")


def transcribed_in_parallel(rows: DataFrame, client: Transcriber, workers: int, **settings) -> DataFrame:
    """As :func:`transcribed` over ``workers`` tasks, where every row counts as a success of its own."""
    return transcribed(rows.repartition(workers, "audio_path"), client, reuse=False, **settings)


def merged(manifests: dict[str, DataFrame]) -> DataFrame:
    """Manifests of several directories, each row with its directory."""
    return manifest.merge(manifests)


# speech


def jobs(samples: DataFrame, voices: DataFrame, instructions: DataFrame, engine: str, settings: Mapping[str, object]) -> DataFrame:
    """Samples by voices (voice) and instructions (instruction, instruct) with the identity of what is to be said."""
    told = t.instruction(F.col("instruct"), F.col("pronunciation_instruction"))
    rows = samples.crossJoin(manifest.checked_specs(voices)).crossJoin(manifest.checked_specs(instructions)).withColumn("told", told)
    own = F.lit(repr(sorted(identity(settings).items())))
    return rows.withColumn("cache_key", audio.cache_key(F.col("tts_text"), F.col("language"), F.lit(engine), own, F.col("voice"), F.col("told"), F.col("phoneme_text")))


def identity(settings: Mapping[str, object]) -> dict[str, object]:
    """Settings without secrets and without what does not change the result."""
    return {k: v for k, v in settings.items() if k not in ("key", "region", "api_key", "workers")}


def spoken(work: DataFrame, client: Synthesizer, done: DataFrame | None = None) -> DataFrame:
    """Jobs with status, error, samples and duration; what ``done`` (cache_key) has is cached, and equal jobs are said once."""
    known = done.select("cache_key", F.lit(True).alias("_done")).distinct() if done is not None else None
    rows = work.join(known, "cache_key", "left") if known is not None else work.withColumn("_done", F.lit(None).cast("boolean"))
    todo = rows.where("_done IS NULL").select("cache_key", "tts_text", "voice", "told", "phoneme_text").dropDuplicates(["cache_key"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, voice, told, phonemes in batch.itertuples(index=False):
                try:
                    pcm, rate = client.synthesize(text, voice, told, phonemes)
                    out.append((key, audio.quantized(audio.resampled(audio.samples(pcm), rate)), None))
                except (OSError, ValueError, RuntimeError) as e:
                    out.append((key, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["cache_key", "pcm", "error"])

    made = todo.mapInPandas(run, "cache_key string, pcm binary, error string")
    out = rows.join(made, "cache_key", "left")
    status = F.when(F.col("_done"), "cached").when(F.col("error").isNotNull(), "error").otherwise("generated")
    return out.withColumns({"status": status, "duration_ms": F.round(F.octet_length("pcm") / 2 * 1000 / audio.RATE).cast("int")}).drop("_done")


def renderable(variants: DataFrame, kinds: list[str]) -> DataFrame:
    """Variants that can be rendered in one of the ways."""
    if unknown := set(kinds) - {"text_approximation", "phoneme_required"}:
        raise ValueError(f"unknown ways to render {sorted(unknown)}")
    return variants.where(F.col("renderability").isin(kinds))


# models


def filtered(candidates: DataFrame, client: Model, done: DataFrame | None = None, missing: str = "keep", retries: int = 2) -> DataFrame:
    """Candidates (canonical, pos, word) with a model's decision on each; replies that ``done`` (canonical, reply) has are not asked for again."""
    asked = candidates.groupBy("canonical").agg(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"].alias("words"))
    todo = asked.join(done, "canonical", "left_anti") if done is not None else asked
    replies = called(todo, ["canonical", "words"], lambda c, words: client.reply(c, list(words)), "reply", retries).select("canonical", "reply")
    replies = replies.unionByName(done.select("canonical", "reply")) if done is not None else replies
    return apply_decisions(candidates, reply_decisions(replies.where("reply IS NOT NULL")), missing=missing)


@contextmanager
def managed(service: Service, timeout: float = 60.0, pause: float = 0.1) -> Iterator[Service]:
    """A service that runs while it is used: started unless it is up, waited for, and stopped if it was started here."""
    own = not service.ready()
    if own:
        service.start()
    try:
        end = time.monotonic() + timeout
        while not service.ready():
            if time.monotonic() > end:
                raise TimeoutError("the service did not come up")
            time.sleep(pause)
        yield service
    finally:
        if own:
            service.stop()


def stale(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs to do again: (condition, repeat) of ``expected`` (with rows and fingerprint) without a run of as many rows, none failed, of that fingerprint."""
    have = runs.groupBy("condition", "repeat").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.max("fingerprint").alias("print"))
    joined = expected.join(have, ["condition", "repeat"], "left")
    good = (F.col("n") == F.col("rows")) & (F.col("errors") == 0) & (F.col("print") == F.col("fingerprint"))
    return joined.where(~F.coalesce(good, F.lit(False))).select("condition", "repeat")


def fingerprint(rows: DataFrame, settings: Mapping[str, object], by: list[str], order: str = "seq") -> DataFrame:
    """A digest for each group of its rows' identities in order and of the settings."""
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(set(rows.columns) - {*by, order}))), 256)
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("h"))))["h"].alias("h"))
    return lists.select(*by, F.sha2(F.concat_ws("\n", F.col("h"), F.lit(repr(sorted(settings.items())))), 256).alias("fingerprint"))


def prompt(mark: str = "<|endofprompt|>") -> Callable[[Column], Column]:
    return lambda x: t.with_end_mark(x, mark)
