"""Perturbations of 16-bit audio in a binary column, by Arrow-batched functions."""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The step between the seeds of a chain, and the energy of silence.
SEED_STEP, SILENCE = 0x9E3779B1, 1e-4


def samples(pcm: bytes) -> np.ndarray:
    return np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(np.float32) / 32767.0


def quantized(x: np.ndarray) -> bytes:
    return np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def perturb(x: np.ndarray, rate: int, spec: dict, seed: int) -> np.ndarray:
    """One perturbation: speed, white_noise, low_pass, hard_clip or a chain of them."""
    kind = spec["type"]
    if kind == "chain":
        for i, step in enumerate(spec["steps"]):
            x = perturb(x, rate, step, seed ^ ((i + 1) * SEED_STEP & 0xFFFFFFFF))
        return x
    if kind == "speed":
        n = max(1, round(len(x) / spec["factor"]))
        return np.interp(np.linspace(0, max(0, len(x) - 1), n), np.arange(len(x)), x).astype(np.float32) if len(x) else x
    if kind == "white_noise":
        power = float(np.sqrt(np.mean(x.astype(np.float64) ** 2))) if len(x) else 0.0
        scale = max(power, SILENCE) / 10 ** (spec["snr_db"] / 20)
        return (x + np.random.default_rng(seed).normal(0, scale, len(x))).astype(np.float32)
    if kind == "low_pass":
        n = max(2, round(rate / spec["cutoff_hz"]))
        return np.convolve(x, np.ones(n) / n, mode="same")[: len(x)].astype(np.float32) if len(x) else x
    if kind == "hard_clip":
        return np.clip(x, -spec["threshold"], spec["threshold"]) / spec["threshold"]
    raise ValueError(f"unknown perturbation {kind}")


def validate(spec: dict, nested: bool = False) -> None:
    limits = {"speed": ("factor", 0.5, 1.5), "white_noise": ("snr_db", 0, 60), "low_pass": ("cutoff_hz", 300, 8000), "hard_clip": ("threshold", 0.05, 1)}
    if spec["type"] == "chain":
        if nested or len(spec["steps"]) < 2:
            raise ValueError("a chain has two steps or more, none of them a chain")
        for step in spec["steps"]:
            validate(step, True)
        return
    name, low, high = limits[spec["type"]]
    if not low <= spec[name] <= high or spec["type"] == "low_pass" and spec[name] == high:
        raise ValueError(f"{name} is out of range")


def augment(df: DataFrame, spec: dict, seed: int = 0, rate: int = 16_000, key: str = "sample_id") -> DataFrame:
    """``pcm`` perturbed; noise depends on the row's key, not on where it runs."""
    validate(spec)

    @F.pandas_udf("binary")
    def run(keys: pd.Series, pcm: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else quantized(perturb(samples(p), rate, spec, seed ^ int(k[:8], 16))) for k, p in zip(keys, pcm)])

    return df.withColumn("pcm", run(F.sha2(F.col(key).cast("string"), 256), "pcm"))


def energy(values: Column) -> Column:
    """Root mean square of an array column."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / F.size(values))


def hard_clip(values: Column, threshold: float) -> Column:
    return F.transform(values, lambda x: F.greatest(F.lit(-threshold), F.least(F.lit(threshold), x.cast("double"))) / threshold)


# files

RATE = 16_000
WAV = "sample_rate int, channels int, bits int, frames int, duration_ms int, pcm binary, pcm_sha256 string, error string"


def opened(data: bytes, strict: bool) -> tuple:
    """A file's samples as mono PCM16; ``strict`` takes 16 kHz mono PCM16 only and leaves it as it is."""
    try:
        with wave.open(io.BytesIO(data)) as f:
            rate, channels, width, n, kind = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes(), f.getcomptype()
            pcm = f.readframes(n)
        if kind != "NONE" or width != 2 or strict and (rate, channels) != (RATE, 1):
            raise ValueError(f"{rate} Hz, {channels} channels, {8 * width} bits are not read")
        if len(pcm) % (2 * channels):
            raise ValueError("the last sample is incomplete")
        if channels > 1:
            pcm = quantized(samples(pcm).reshape(-1, channels).mean(axis=1))
        return rate, channels, 16, n, round(n * 1000 / rate), pcm, hashlib.sha256(pcm).hexdigest(), None
    except (wave.Error, EOFError, ValueError, ZeroDivisionError) as e:
        return None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]


def read_wav(files: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    """Adds ``wav`` to binary files; one that cannot be read has the reason in ``wav.error``."""
    names = [c.split()[0] for c in WAV.split(", ")]

    @F.pandas_udf(WAV)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([opened(v if v is not None else b"", strict) for v in x], columns=names, dtype=object)

    return files.withColumn("wav", run(F.col(content)))


def mono(x: np.ndarray) -> np.ndarray:
    """Float samples of one channel from any shape and type; integers, and floats beyond 1, are scaled."""
    x = np.asarray(x)
    whole = np.issubdtype(x.dtype, np.integer)
    scale = max(abs(np.iinfo(x.dtype).min), np.iinfo(x.dtype).max) if whole else 1.0
    if x.ndim == 2:
        x = x.mean(axis=0 if x.shape[0] <= 2 else 1)
    elif x.ndim > 2:
        raise ValueError(f"samples of shape {x.shape}")
    x = x.astype(np.float32).reshape(-1) / np.float32(scale)
    return x if whole or np.max(np.abs(x), initial=0.0) <= 1.0 else x / np.float32(32768)


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate <= 0:
        raise ValueError("a rate is positive")
    if rate == to or not len(x):
        return x
    return np.interp(np.linspace(0, len(x) - 1, max(1, round(len(x) * to / rate))), np.arange(len(x)), x).astype(np.float32)


def wav_bytes(pcm: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(pcm)
    return out.getvalue()


def write_wav(df: DataFrame, pcm: str = "pcm", rate: str = "sample_rate") -> DataFrame:
    """Adds ``content``, a 16 kHz mono file, and ``duration_ms``; null for no samples."""

    @F.pandas_udf("content binary, duration_ms int")
    def run(x: pd.Series, rates: pd.Series) -> pd.DataFrame:
        rows = []
        for data, r in zip(x, rates):
            own = None if not data else quantized(resampled(np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768, int(r)))
            rows.append((None, None) if own is None else (wav_bytes(own), round(len(own) // 2 * 1000 / RATE)))
        return pd.DataFrame(rows, columns=["content", "duration_ms"], dtype=object)

    return df.withColumn("_w", run(F.col(pcm), F.col(rate))).select("*", "_w.*").drop("_w")


def frames(df: DataFrame, key: str, pcm: str = "pcm", frame_ms: int = 20, rate: int = RATE) -> DataFrame:
    """(key, start, end, energy) of frames of 16-bit samples: milliseconds, and mean loudness as a share of a fifth of the most."""
    step = round(rate * frame_ms / 1000)

    @F.pandas_udf("array<struct<start:int,end:int,energy:double>>")
    def run(x: pd.Series) -> pd.Series:
        def of(data: bytes | None) -> list[dict]:
            own = np.abs(np.frombuffer((data or b"")[: len(data or b"") // 2 * 2], "<i2").astype(np.int64))
            at = range(0, len(own), step)
            return [{"start": round(a * 1000 / rate), "end": round(min(a + step, len(own)) * 1000 / rate), "energy": min(1.0, float(own[a : a + step].mean()) / (32768 * 0.2))} for a in at]

        return x.map(of)

    return df.select(key, F.inline(run(F.col(pcm))))


# rendering


def cache_key(*parts: Column) -> Column:
    """Names a rendering by what it is made of."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)), 256), 1, 12)


def render(df: DataFrame, specs: list[dict], done: DataFrame | None = None, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """Every row (key, pcm, sample_rate, status) with every perturbation: name, type, cache_key, status, pcm and duration_ms.

    Rows that are not ready are skipped. What ``done`` (cache_key) has is cached and not rendered again.
    """
    if len({s["name"] for s in specs}) < len(specs):
        raise ValueError("names of perturbations differ")
    for s in specs:
        validate(s)
    by_name = {s["name"]: s for s in specs}
    text = {n: repr(sorted(s.items())) for n, s in by_name.items()}
    table = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s["type"]).alias("type"), F.lit(text[n]).alias("_spec")) for n, s in by_name.items()))
    rows = df.select("*", F.inline(table)).withColumn("cache_key", cache_key(F.sha2("pcm", 256), F.col("_spec"), F.lit(seed)))
    known = done.select("cache_key", F.lit(True).alias("_done")).distinct() if done is not None else None
    rows = rows.join(known, "cache_key", "left") if known is not None else rows.withColumn("_done", F.lit(None).cast("boolean"))
    ready = F.col("status").isin("generated", "cached")
    status = F.when(~F.coalesce(ready, F.lit(False)), "skipped").when(F.col("pcm").isNull(), "error").when(F.col("_done"), "cached").otherwise("generated")

    @F.pandas_udf("binary")
    def run(names: pd.Series, keys: pd.Series, pcm: pd.Series, rates: pd.Series) -> pd.Series:
        made = (perturb(samples(p), int(r), by_name[n], seed ^ int(k[:8], 16)) if p is not None else None for n, k, p, r in zip(names, keys, pcm, rates))
        return pd.Series([None if x is None else quantized(resampled(x, int(r))) for x, r in zip(made, rates)])

    rows = rows.withColumns({"status": status, "source_tts_status": F.col("status")})
    wanted = F.when(F.col("status") == "generated", F.col("pcm"))
    out = rows.withColumn("pcm", run("name", "cache_key", wanted, "sample_rate")).drop("_spec", "_done")
    return out.withColumn("duration_ms", F.round(F.octet_length("pcm") / 2 * 1000 / RATE).cast("int"))
