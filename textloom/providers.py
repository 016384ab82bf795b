"""External models behind small protocols, with fakes that always answer alike, and the operators that call them.

Models are called from Arrow batches, as many at a time as there are tasks: a
provider must be picklable.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import segments

BATCH_CHARS = 16_384
PROBE_LOW, PROBE_HIGH = 256, 200_000
CHARS_A_TOKEN, EXTRA_TOKENS = 2, 16
INPUT_SHARE = 50  # percent of a chat model's context that a request takes
SHRINKS, SHRINK = 2, 0.75
LOOP_TEMPERATURE, LOOP_PENALTY = 0.3, 0.5


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ImageEmbedder(Protocol):
    def embed_images(self, images: list[bytes]) -> list[list[float]]: ...


class PageEngine(Protocol):
    name: str

    def read(self, image: bytes) -> tuple[str, float]:
        """Text and mean confidence (0: unknown)."""
        ...


class Chatter(Protocol):
    def chat(self, messages: list[dict], **options) -> str: ...


class TokenCounter(Protocol):
    def count(self, text: str) -> int: ...


class TooLong(Exception):
    """A model refused its input as too long."""


class Refused(Exception):
    """A call that may be tried again: what the server said, and how long it asks to wait (seconds; 0: it does not say)."""

    def __init__(self, status: int = 0, body: str = "", wait: float = 0.0, ahead: int = 0):
        super().__init__(f"{status} {body}")
        self.status, self.body, self.wait, self.ahead = status, body, wait, ahead

    @property
    def kind(self) -> str:
        return "429" if self.status == 429 else "5xx" if self.status >= 500 else "transport"


# ---------------------------------------------------------------- calls in flight

SLOTS, TRIES, PAUSE, LONGEST_PAUSE = 4, 5, 0.5, 30.0
EVENT = "struct<kind:string,delay:double,elapsed:double,status:int,body:string,ahead:int>"


def patiently(call: Callable, item, tries: int = TRIES, pause: float = PAUSE):
    """(answer, error, events) of one call, tried again while it is refused: after as long as it asks for, else twice as long each time.

    Events are what ``queue.retry_tally`` counts: one for each refusal, and one that tells
    how it ended.  Another error ends the call at once.
    """
    events, began = [], time.monotonic()
    tell = lambda kind, delay=0.0, e=None: events.append({"kind": kind, "delay": delay, "elapsed": time.monotonic() - began, "status": e.status if e else 0, "body": e.body if e else "", "ahead": e.ahead if e else 0})
    for n in range(tries):
        try:
            answer = call(item)
        except Refused as refused:
            if n + 1 == tries:
                tell("gave-up", 0.0, refused)
                return None, str(refused), events
            delay = min(LONGEST_PAUSE, refused.wait or pause * 2**n)
            tell(refused.kind, delay, refused)
            time.sleep(delay)
        except Exception as fault:  # what a provider raises is its own
            return None, f"{type(fault).__name__}: {fault}", events
        else:
            if events:
                tell("recovered")
            return answer, None, events
    return None, "no try", events


def in_order(call: Callable, items: Iterable, slots: int = SLOTS, tries: int = TRIES, pause: float = PAUSE) -> Iterator[tuple]:
    """(item, answer, error, events) of all items in their order, ``slots`` of them on their way at a time.

    An item is taken when a slot is free, and at most ``slots`` answers wait for an
    earlier one: memory does not grow with the items.
    """
    with ThreadPoolExecutor(slots) as pool:
        waiting: deque = deque()
        for item in items:
            if len(waiting) == slots:
                done, future = waiting.popleft()
                yield done, *future.result()
            waiting.append((item, pool.submit(patiently, call, item, tries, pause)))
        while waiting:
            done, future = waiting.popleft()
            yield done, *future.result()


def called(rows: DataFrame, value: str, call: Callable, answer: str, slots: int = SLOTS, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """``rows`` with what ``call`` answers for a column (of type ``answer``), ``error`` where it failed, and the ``events`` of its retries.

    Each task keeps ``slots`` calls in flight; rows keep their order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"answer {answer}, error string, events array<{EVENT}>")
    whole = StructType([*rows.schema.fields, *schema.fields])
    arrow = to_arrow_schema(whole)

    def run(batches):
        for batch in batches:
            found = list(in_order(call, batch.column(batch.schema.get_field_index(value)).to_pylist(), slots, tries, pause))
            added = pa.RecordBatch.from_pylist([{"answer": a, "error": e, "events": v} for _, a, e, v in found], schema=pa.schema([arrow.field(c) for c in schema.names]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.columns], names=whole.names)

    return rows.mapInArrow(run, whole)


def retry_events(found: DataFrame, job: str) -> DataFrame:
    """(job_id, seq, kind, delay, elapsed, status, body, ahead): the events of ``called`` as rows of jobs, for ``queue.retry_tally``."""
    return found.select(F.col(job).alias("job_id"), F.posexplode("events").alias("seq", "e")).select("job_id", "seq", "e.*")


# ---------------------------------------------------------------- fakes


@dataclass(frozen=True)
class FakeEmbedder:
    """One axis for each of ``axes``: how often a text has that word; ``limit`` characters at most (0: any)."""

    axes: tuple[str, ...] = ("auth", "deploy", "billing")
    limit: int = 0

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.limit and any(len(t) > self.limit for t in texts):
            raise TooLong(f"input is larger than the maximum context size; batch size: {self.limit // CHARS_A_TOKEN}")
        return [[float(t.lower().count(a)) for a in self.axes] for t in texts]


@dataclass(frozen=True)
class FakeImageEmbedder:
    dim: int = 3

    def embed_images(self, images: list[bytes]) -> list[list[float]]:
        return [[float(b) for b in hashlib.sha256(i).digest()[: self.dim]] for i in images]


@dataclass(frozen=True)
class FakeEngine:
    """Reads an image whose bytes are its text."""

    name: str = "cheap"
    confidence: float = 0.9
    most: int = 0

    def read(self, image: bytes) -> tuple[str, float]:
        if self.most and len(image) > self.most:
            raise TooLong("image too large")
        return image.decode("utf-8", "replace"), self.confidence


@dataclass
class FakeChatter:
    """Gives its answers one after the other, the last one again and again, and keeps what it was asked."""

    answers: list[str]
    asked: list[list[dict]] = field(default_factory=list)
    options: list[dict] = field(default_factory=list)

    def chat(self, messages: list[dict], **options) -> str:
        self.asked.append(list(messages))
        self.options.append(options)
        return self.answers[min(len(self.asked), len(self.answers)) - 1]


# ---------------------------------------------------------------- embedding


def normalised(vector) -> list[float]:
    v = np.asarray(vector, np.float32)
    n = float(np.sqrt(np.dot(v, v)))
    return (v / n if n else v).tolist()


def batches_of(texts: list[str], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Texts in order, as many at a time as ``most`` characters allow; a longer one goes alone."""
    batch, n = [], 0
    for t in texts:
        if batch and n + len(t) > most:
            yield batch
            batch, n = [], 0
        batch.append(t)
        n += len(t)
    if batch:
        yield batch


def embed_all(embedder: Embedder, texts: list[str], prefix: str = "", most: int = BATCH_CHARS, slots: int = 1) -> list[list[float]]:
    """Unit vectors of texts in order, ``slots`` requests in flight; an error of one is raised."""
    batches = batches_of([prefix + t for t in texts], most)
    if slots == 1:
        return [normalised(v) for batch in batches for v in embedder.embed(batch)]
    out = []
    for _, vectors, error, _ in in_order(embedder.embed, batches, slots):
        if error:
            raise RuntimeError(error)
        out += map(normalised, vectors)
    return out


def embedded(rows: DataFrame, key: str, text: str, embedder: Embedder, prefix: str = "", slots: int = 1) -> DataFrame:
    """(key, vector): unit vectors of all texts (null: empty); each task keeps ``slots`` requests in flight."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "vector": embed_all(embedder, batch[text].fillna("").tolist(), prefix, slots=slots)})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def embedded_media(media: DataFrame, embedder: Embedder | None, images: ImageEmbedder | None = None, aligned: bool = False) -> DataFrame:
    """(media_id, space, vector) of media (media_id, description, image): by the image where there are one and a model for it, else by the description.

    What fails is left out; a description that is blank has no vector.
    """
    kind = media.schema["media_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    if images is not None and r.image is not None and len(r.image):
                        rows.append((r.media_id, "image-aligned" if aligned else "image", normalised(images.embed_images([bytes(r.image)])[0])))
                    elif embedder is not None and (r.description or "").strip():
                        rows.append((r.media_id, "text", embed_all(embedder, [r.description])[0]))
                except (TooLong, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["media_id", "space", "vector"])

    return media.select("media_id", "description", "image").mapInPandas(run, f"media_id {kind}, space string, vector array<float>")


def embed_limit(embedder: Embedder) -> int:
    """The longest input that a model takes, within PROBE_LOW characters: doubled until it refuses, then halved."""

    def takes(n: int) -> bool:
        try:
            embedder.embed([("a " * (n // 2 + 1))[:n]])
        except TooLong:
            return False
        return True

    if not takes(PROBE_LOW):
        raise TooLong(f"the model refuses {PROBE_LOW} characters")
    low = PROBE_LOW
    while low * 2 <= PROBE_HIGH and takes(low * 2):
        low *= 2
    if low * 2 > PROBE_HIGH:
        return PROBE_HIGH
    high = low * 2
    while high - low > PROBE_LOW:
        mid = (low + high) // 2
        low, high = (mid, high) if takes(mid) else (low, mid)
    return low


def characters(tokens: int) -> int:
    return max(1, (tokens - EXTRA_TOKENS) * CHARS_A_TOKEN)


def limit_from_error(text: str) -> int | None:
    """Characters that a model's refusal says it takes."""
    found = re.search(r"(?i)batch size:\s*(\d+)", text)
    return characters(int(found[1])) if found and int(found[1]) > 0 else None


def input_limit(configured: int, context: int) -> int:
    """Tokens of a request: as configured, else the input's share of the model's context; 0 where neither is known."""
    return configured if configured > 0 else context * INPUT_SHARE // 100


# ---------------------------------------------------------------- pages


def engine_named(name: str, engines: dict[str, PageEngine]) -> PageEngine | None:
    """The page engine of a setting: none for ``none`` or nothing; an unknown one is an error."""
    if name.strip().lower() in ("", "none"):
        return None
    if name not in engines:
        raise ValueError(f"unknown page engine {name!r}: {sorted(engines)}")
    return engines[name]


def page_reading(image: bytes, cheap: PageEngine | None, vision: PageEngine | None, gibberish, shrink=None) -> tuple[str, str, int]:
    """(text, engine, shrinks): the cheap engine's text unless ``gibberish(text, confidence)``, else the vision model's.

    An image that the vision model finds too large is shrunk twice at most by
    ``shrink(image, factor)``.  Without a vision model the cheap text stays: no page is dropped.
    """
    text = None
    if cheap is not None:
        text, confidence = cheap.read(image)
        if vision is None or not gibberish(text, confidence):
            return text.strip(), cheap.name, 0
    if vision is None:
        raise ValueError("no engine can read the page")
    for k in range(SHRINKS + 1):
        try:
            return vision.read(image)[0].strip(), "vision", k
        except TooLong:
            if k == SHRINKS or shrink is None:
                raise
            image = shrink(image, SHRINK)
    raise AssertionError


def is_gibberish(text: str, confidence: float) -> bool:
    """The gate of ``functions.text.gibberish`` for one page."""
    words = text.split()
    if not words:
        return False
    junk = sum(c == "�" or (ord(c) < 32 and c not in "\t\n\r") or "\x7f" <= c <= "\x9f" for c in text)
    if junk / len(text) > 0.05 or 0 < confidence < 0.55:
        return True

    def good(word: str) -> bool:
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        letters = sum(c.isalpha() for c in bare)
        if not bare or len(bare) > 24:
            return False
        return bare.isdecimal() or (bool(re.search("[aeiouy]", bare.lower())) if letters >= 3 else letters > 0)

    return len(words) >= 8 and sum(map(good, words)) / len(words) < 0.35


def read_pages(images: DataFrame, cheap: PageEngine | None, vision: PageEngine | None, cache: DataFrame | None = None, shrink=None) -> DataFrame:
    """(path, page, sha, text, engine, cached) of page images (path, page, image).

    ``cache`` (sha, engine, text) answers for images that were read before; equal
    images are read once.  What goes into a cache is ``to_cache``.
    """
    hashed = images.withColumn("sha", F.sha2("image", 256))
    once = hashed.groupBy("sha").agg(F.first("image").alias("image"))
    if cache is not None:
        once = once.join(cache.select("sha"), "sha", "left_anti")

    def run(batches):
        for batch in batches:
            rows = [(s, *page_reading(bytes(i), cheap, vision, is_gibberish, shrink)[:2]) for s, i in zip(batch["sha"], batch["image"])]
            yield pd.DataFrame(rows, columns=["sha", "text", "engine"])

    read = once.mapInPandas(run, "sha string, text string, engine string").withColumn("cached", F.lit(False))
    if cache is not None:
        read = read.unionByName(cache.select("sha", "text", "engine").withColumn("cached", F.lit(True)))
    return hashed.select("path", "page", "sha").join(read, "sha").select("path", "page", "sha", "text", "engine", "cached")


def to_cache(read: DataFrame) -> DataFrame:
    """Readings worth keeping: a blank one may be a fault of the moment."""
    return read.where("not cached and trim(text) <> ''").select("sha", "engine", "text").dropDuplicates(["sha"])


# ---------------------------------------------------------------- chat


def looped(text: str, least: int = 40, times: int = 3) -> int | None:
    """Where an answer begins to repeat one block of ``least`` characters or more, ``times`` times to its end; null where it does not."""
    for size in range(least, len(text) // times + 1):
        if text.endswith(text[len(text) - size :] * times):
            at = len(text) - size * times
            while at >= size and text[at - size : at] == text[at : at + size]:
                at -= size
            return at
    return None


def asked_until_good(chatter: Chatter, prompt: str, check, retries: int = 3, **options):
    """(answer, None) once ``check`` takes an answer's JSON object, else (None, last fault).

    ``check`` raises ValueError with what is wrong, which the next request says.  An
    answer that loops is asked for again with other sampling.
    """
    messages, fault = [{"role": "user", "content": prompt}], None
    for _ in range(retries + 1):
        answer = chatter.chat(messages, **options)
        if looped(answer) is not None:
            fault, options = "the answer repeats itself", {**options, "temperature": LOOP_TEMPERATURE, "frequency_penalty": LOOP_PENALTY}
        else:
            found = re.search(r"(?s)\{.*\}", answer)
            try:
                if not found:
                    raise ValueError("no JSON object")
                return check(json.loads(found[0])), None
            except (ValueError, KeyError, TypeError) as wrong:
                fault = str(wrong)
        messages += [{"role": "assistant", "content": answer[:800]}, {"role": "user", "content": f"That was not valid: {fault}. Answer with the JSON object alone."}]
    return None, fault


def segmented(chatter: Chatter, text: str, before: str = "", budget: segments.Budget | None = None, retries: int = 3) -> tuple[list[str], bool, str]:
    """(segments, whether the first continues what is open, why it was given up): a page's text cut by a model; the whole page where it fails."""

    def check(found: dict) -> tuple[list[str], bool]:
        texts = [f["text"] for f in found.get("fragments", [])]
        if not texts:
            raise ValueError("no fragments")
        over = segments.oversized(texts, budget) if budget else {}
        if over:
            raise ValueError(segments.complaint(over))
        return texts, bool(found.get("continues_previous"))

    good, fault = asked_until_good(chatter, f"OPEN:\n{before}\n\nPAGE:\n{text}", check, retries)
    return (*good, "") if good else ([text], False, fault or "")


def excerpt(text: str, head: int = 12_000, tail: int = 4_000) -> str:
    """What a model is shown of a document: all, or its begin and its end with a mark between."""
    if len(text) <= head + tail:
        return text
    low = len(text) - tail
    return text[: segments.boundary(text, head)] + "\n\n[… not shown …]\n\n" + text[low + segments.boundary(text[low:], 200) :]


def identified(chatter: Chatter, text: str, kinds: dict[str, str], retries: int = 3) -> dict | None:
    """name, summary and kind of a document by a model; nothing where it has too little text or no answer was good.

    ``kinds``: names a kind may have, and the kinds that they are.
    """
    if sum(c.isalpha() or c.isdecimal() for c in text) < 200:
        return None

    def check(found: dict) -> dict:
        name, summary, kind = " ".join(str(found["name"]).split()), str(found["summary"]).strip(), str(found["kind"]).strip().lower().strip(".")
        if not 0 < len(name) <= 200:
            raise ValueError("name is empty or too long")
        if not 40 <= len(summary) <= 2500:
            raise ValueError("summary says nothing or is too long")
        if kind not in kinds:
            raise ValueError("kind is unknown")
        return {"name": name, "summary": summary, "kind": kinds[kind]}

    return asked_until_good(chatter, "What is this document?\n\n" + excerpt(text), check, retries)[0]
