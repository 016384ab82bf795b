"""Mail archives: mbox files split into messages, messages into headers, body text and attachments."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_MESSAGES = 100_000  # an archive with more is refused, not cut
DEPTH = 12
SCHEMA = "path string, page int, subject string, sender string, sent string, body string, attachments array<struct<name:string,sha256:string,bytes:long>>, error string"


def split_mbox(raw: bytes) -> Iterator[bytes]:
    """Messages of an mbox: "From " begins one at the start or after a blank line; one ">" of a quoted "From " goes."""
    message: list[bytes] = []
    after_blank = True
    for line in re.findall(rb"[^\n]*\n|[^\n]+", raw):
        if after_blank and line.startswith(b"From "):
            if message:
                yield b"".join(message)
            message, after_blank = [], False
            continue
        if re.match(rb">+From ", line):
            line = line[1:]
        message.append(line)
        after_blank = not line.rstrip(b"\r\n")
    if message:
        yield b"".join(message)


def plain(html: str) -> str:
    """Words of an HTML body: what stands between angle brackets goes, nested or not, and blank lines."""
    depth, out = 0, []
    for piece in re.split(r"([<>])", html):
        if piece == "<":
            depth += 1
        elif piece == ">":
            depth = max(0, depth - 1)
            if not depth:
                out.append(" ")
        elif not depth:
            out.append(piece)
    return "\n".join(line.strip() for line in "".join(out).split("\n") if line.strip())


def _decoded(part: Message) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:  # a charset that nobody knows: as it is
        return raw.decode("utf-8", "replace")


def _body(part: Message, files: list, messages: list, depth: int) -> list[tuple[str, str]]:
    """(kind, text) of a part; files and nested messages are put aside."""
    kind = part.get_content_type()
    if depth > DEPTH:
        return []
    if kind == "message/rfc822":
        messages += part.get_payload() if part.is_multipart() else []
        return []
    if part.is_multipart():
        texts = [t for p in part.get_payload() for t in _body(p, files, messages, depth + 1)]
        if kind == "multipart/alternative":
            for wanted in ("text/plain", "text/html"):
                good = [t for k, t in texts if k == wanted and t.strip()]
                if good:
                    return [(wanted, good[-1])]
        return texts
    if part.get_filename() or part.get_content_disposition() == "attachment":
        files.append((part.get_filename() or "", part.get_payload(decode=True) or b""))
        return []
    return [(kind, plain(_decoded(part)) if kind == "text/html" else _decoded(part))] if kind.startswith("text/") else []


def _header(message: Message, name: str) -> str | None:
    value = message.get(name)
    try:
        return None if value is None else str(make_header(decode_header(str(value))))
    except (LookupError, ValueError):
        return str(value)


def messages_of(raw: bytes, whole: bool = False) -> Iterator[dict]:
    """Every message of an archive (or of a single message file), nested ones after the one that holds them.

    A file with the digest of an earlier one of the archive is listed but counts 0
    bytes.  ``whole``: the bytes are one message, however they begin.
    """
    seen: set[str] = set()
    first = raw.startswith(b"From ") and not whole
    waiting = [(message_from_bytes(m, policy=policy.compat32), 0) for m in (split_mbox(raw) if first else [raw] if raw else [])]
    if len(waiting) > MOST_MESSAGES:
        raise ValueError(f"more than {MOST_MESSAGES} messages")
    waiting.reverse()
    while waiting:
        message, depth = waiting.pop()
        files, nested = [], []
        texts = _body(message, files, nested, 0)
        if depth < DEPTH:
            waiting += [(m, depth + 1) for m in reversed(nested)]
        listed = []
        for name, content in files:
            digest = hashlib.sha256(content).hexdigest()
            listed.append({"name": name, "sha256": digest, "bytes": 0 if digest in seen else len(content)})
            seen.add(digest)
        body = "\n\n".join(t for _, t in texts if t.strip())
        yield {"subject": _header(message, "Subject"), "sender": _header(message, "From"), "sent": _header(message, "Date"), "body": body, "attachments": listed}


def safe_name(name: str | None, kind: str = "") -> str:
    """A file name without folders, control characters or a leading dot; one of its kind where nothing is left."""
    bare = re.sub(r"[\x00-\x1f<>:\"|?*]", "", re.split(r"[\\/]", name or "")[-1]).strip().lstrip(".")
    return bare[-120:] or f"attachment.{(kind.split('/')[-1] or 'bin')}"


def attachments_of(raw: bytes) -> Iterator[tuple[int, str, str, bytes]]:
    """(page of its message, safe name, digest, content) of each file in an archive, a digest once."""
    seen: set[str] = set()
    waiting = [(message_from_bytes(m, policy=policy.compat32), 0) for m in (split_mbox(raw) if raw.startswith(b"From ") else [raw] if raw else [])]
    waiting.reverse()
    page = 2
    while waiting:
        message, depth = waiting.pop()
        files, nested = [], []
        _body(message, files, nested, 0)
        if depth < DEPTH:
            waiting += [(m, depth + 1) for m in reversed(nested)]
        for name, content in files:
            digest = hashlib.sha256(content).hexdigest()
            if digest not in seen:
                seen.add(digest)
                yield page, safe_name(name), digest, content
        page += 1


def read_attachments(files: DataFrame) -> DataFrame:
    """(path, page, name, sha256, content): the files in archives (path, content), equal bytes once an archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *found) for path, content in zip(batch["path"], batch["content"]) for found in attachments_of(bytes(content or b""))]
            yield pd.DataFrame(rows, columns=["path", "page", "name", "sha256", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, name string, sha256 string, content binary")


def manifest(mail: DataFrame) -> DataFrame:
    """(path, page, body): page 1 of each archive of ``read_mail``: how many messages it has, and a line for each with its page."""
    line = F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), F.coalesce("subject", F.lit("(no subject)")), F.when(F.col("sender").isNotNull(), F.concat(F.lit(", from "), "sender")).otherwise(""), F.when(F.size("attachments") > 0, F.concat(F.lit(", files: "), F.array_join(F.transform("attachments", lambda a: a["name"]), ", "))).otherwise(""))
    listed = mail.where("error is null").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", line.alias("line")))).alias("x"))
    return listed.select("path", F.lit(1).alias("page"), F.concat(F.size("x").cast("string"), F.lit(" messages\n"), F.array_join("x.line", "\n")).alias("body"))


def read_mail(files: DataFrame) -> DataFrame:
    """A row for each message of the archives (path, content); page 1 is left for a manifest, so messages begin at page 2.

    An archive that cannot be read is one row with its error; empty or null content has no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [{"path": path, "page": n, **m, "error": None} for n, m in enumerate(messages_of(bytes(content or b"")), 2)]
                except ValueError as error:
                    rows = [{"path": path, "page": None, "subject": None, "sender": None, "sent": None, "body": None, "attachments": None, "error": str(error)}]
                if rows:
                    yield pd.DataFrame(rows).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
