"""Scalar text functions as Spark expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def fold(text: Column) -> Column:
    """Lower case, letters and decimal digits only."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def content_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def junk_share(text: Column) -> Column:
    """Replacement and control characters but tab, newline and return, over all characters."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def wordlike(word: Column) -> Column:
    """A token that could be a word: not too long; digits alone; from three letters on with a vowel."""
    bare = F.regexp_replace(word, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", ""))
    return F.when(F.length(bare) > 24, False).when(F.length(bare) == 0, False).when(bare.rlike(r"^\p{Nd}+$"), True).when(letters >= 3, F.lower(bare).rlike("[aeiouy]")).otherwise(letters > 0)


def gibberish(text: Column, confidence: Column) -> Column:
    """Why a recognised page should be read again, or 'ok'; the first reason in a fixed order."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    share = F.size(F.filter(words, wordlike)) / F.size(words)
    return F.when(F.size(words) == 0, "ok").when(junk_share(text) > 0.05, "junk").when((confidence > 0) & (confidence < 0.55), "confidence").when((F.size(words) >= 8) & (share < 0.35), "words").otherwise("ok")


def suspicion(text: Column) -> Column:
    """'short-lines', 'thin' or nothing, for a page's text."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.length(F.trim(x)))
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + x) / F.size(lines)
    return F.when(F.size(lines) == 0, "").when((F.size(lines) >= 4) & (mean < 6), "short-lines").when(content_chars(text) < 220, "thin").otherwise("")


def minified(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), lambda x: F.octet_length(x))) >= 5000


def numeric_tokens(text: Column) -> Column:
    """Numbers of two characters or more, without thousands separators."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d)", ""), F.lit(r"\d+(\.\d+)?"), 0)
    return F.filter(found, lambda x: F.length(x) >= 2)


def line_repetition(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) > 0, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(0.0)


def outside_brackets(text: str) -> str:
    """Characters outside angle brackets, however deep these nest; a blank where an outermost bracket closes."""
    depth, out = 0, []
    for piece in re.split("([<>])", text):
        if piece == "<":
            depth += 1
        elif piece == ">":
            depth = max(0, depth - 1)
            if not depth:
                out.append(" ")
        elif not depth:
            out.append(piece)
    return "".join(out)


@F.pandas_udf(StringType())
def _without_tags(text: pd.Series) -> pd.Series:
    """``outside_brackets``, for the few texts whose brackets nest or stay open; the others come as nulls."""
    return text.map(outside_brackets, na_action="ignore")


def html_text(html: Column) -> Column:
    """Tags dropped (their content and entities stay) and a blank where each closes, lines trimmed, blank ones dropped."""
    flat = F.regexp_replace(html, "<[^<>]*>", " ")
    odd = flat.contains("<") | flat.contains(">")
    bare = F.when(odd, _without_tags(F.when(odd, html))).otherwise(flat)
    lines = F.transform(F.split(bare, "\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def flat(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return stripped(F.regexp_replace(text, r"\s+", " "))


def one_line(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def spelling_mask(text: Column) -> Column:
    masked = F.regexp_replace(text, r"[0-9]+", "█")
    return F.when(F.regexp_replace(masked, r"[█\s]", "") == "", "").otherwise(masked)


def excerpt_around(text: Column, name: str, reach: int = 80) -> Column:
    at = F.instr(text, name)
    begin = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at + len(name) + reach - begin)).otherwise(F.substring(text, 1, 2 * reach))


def identity_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), 256)


def index_name(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "")
    return F.when(bare == "", "default").otherwise(bare)


# fixed values: extensions of each kind
EXTENSIONS = {
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "tif", "tiff", "webp", "gif", "bmp", "heic", "heif"],
    "office": ["docx", "odt", "epub", "html", "htm", "pptx", "rtf", "tex", "latex", "org", "rst", "textile", "mediawiki", "docbook", "fb2", "doc"],
    "spreadsheet": ["xlsx", "xls"],
    "email": ["eml", "mbox"],
    "text": ["txt", "md", "markdown", "text", "csv"],
}


def document_kind(path: Column, content_type: Column | None = None) -> Column:
    """The kind of a file by its extension, else by its content type."""
    ext, kind = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)), F.lower(F.coalesce(content_type if content_type is not None else F.lit(""), F.lit("")))
    has = lambda *marks: F.greatest(*(kind.contains(m) for m in marks), F.lit(False))
    starts = lambda *marks: F.greatest(*(kind.startswith(m) for m in marks), F.lit(False))
    # fixed values: content types of each kind
    types = {"pdf": has("application/pdf"), "image": starts("image/"), "office": F.lit(False), "spreadsheet": has("spreadsheetml", "ms-excel"), "email": starts("message/rfc822"), "text": starts("text/plain", "text/markdown")}
    late = has("officedocument", "opendocument", "epub", "rtf", "text/html", "application/msword")
    out = F.when(F.lit(False), F.lit(""))
    for name, extensions in EXTENSIONS.items():
        out = out.when(ext.isin(extensions) | types[name], name)
    return out.when(late, "office").otherwise("unknown")


# fixed values: first bytes of files, in hex, and their kinds
MAGIC = {"255044462D": "pdf", "89504E470D0A1A0A": "image", "FFD8FF": "image", "474946383761": "image", "474946383961": "image", "49492A00": "image", "4D4D002A": "image", "D0CF11E0A1B11AE1": "office"}


def sniffed_kind(content: Column) -> Column:
    """The kind that a file's first eight bytes tell."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.lit(False), F.lit(""))
    for mark, kind in MAGIC.items():
        out = out.when(head.startswith(mark), kind)
    return out.otherwise("unknown")


# fixed values: signatures (hex, % for any byte) that the published sniffing rules call an image, sound, film, pdf or archive
MEDIA = (
    "00000100", "00000200", "424D", "474946383761", "474946383961", "52494646%%%%57454250", "89504E470D0A1A0A", "FFD8FF",
    "464F524D%%%%41494646", "494433", "4F67675300", "4D54686400000006", "52494646%%%%41564920", "52494646%%%%57415645", "1A45DFA3",
    "255044462D", "504B0304", "1F8B08",
)


def opaque(content: Column) -> Column:
    """Bytes that are neither text, nor an image, sound, film, pdf or archive, by the first 512; nothing at all is not opaque."""
    head = F.hex(F.substring(content, 1, 512))
    pattern = "|".join(m.replace("%", "..") for m in MEDIA)
    films = r"^(........66747970)"
    binary = r"^(..)*(0[0-8]|0B|0[EF]|1[0-9A]|1[C-F])"
    marks = r"^(EFBBBF|FEFF|FFFE)"
    return F.coalesce((F.length(head) > 0) & ~head.rlike(marks) & ~head.rlike(f"^({pattern})") & ~head.rlike(films) & head.rlike(binary), F.lit(False))


def relation(matched: Column, a: Column, b: Column) -> Column:
    """What two documents are to each other, by matched characters and both coverages."""
    return F.when(matched < 250, "overlap").when((a >= 0.55) & (b >= 0.55), "duplicate").when(a >= 0.55, "contained").when(b >= 0.55, "contains").otherwise("overlap")


def without_line_numbers(text: Column) -> Column:
    """A pleading's line numbers as blanks, where a fifth of the lines that aren't blank, and eight, have one."""
    mark = r"^[ \t]{0,4}\d{1,2}[ \t](\S)"
    lines = F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")
    numbered = F.size(F.filter(lines, lambda x: F.concat(x, F.lit(" ")).rlike(mark)))
    return F.when((numbered >= 8) & (numbered * 5 >= F.size(lines)), F.regexp_replace(text, "(?m)" + mark, " $1")).otherwise(text)


def sketch_recipe(width: int, modulus: int) -> str:
    return f"sh1/w{width}/m{modulus}"


def sampled(value: Column, modulus: int) -> Column:
    """Whether a hash, read as unsigned, is divisible by ``modulus``; all are where that is 1 or less."""
    if modulus <= 1:
        return F.lit(True)
    if modulus & (modulus - 1) == 0:
        return value.bitwiseAND(modulus - 1) == 0
    high, low = F.shiftrightunsigned(value, 32), value.bitwiseAND(0xFFFFFFFF)
    return (high * ((1 << 32) % modulus) + low) % modulus == 0


def token_estimate(text: Column, ratio: float = 0.5, extra: int = 16) -> Column:
    """Tokens that a text has at most, by its bytes."""
    return F.floor(F.octet_length(text) * ratio).cast("int") + extra


def numbers_differ(a: Column, b: Column) -> Column:
    """Whether two texts disagree about any number."""
    x, y = numeric_tokens(a), numeric_tokens(b)
    return (F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0)


def percent(share: Column) -> Column:
    return F.when(share <= 0, "an unmeasured share").when(share < 0.001, "under 0.1%").when(share < 0.01, F.format_string("%.1f%%", share * 100)).otherwise(F.concat(F.bround(share * 100).cast("long").cast("string"), F.lit("%")))


def few(tokens: Column) -> Column:
    """Three tokens at most, in order, and how many more there are."""
    ordered = F.array_sort(tokens)
    more = F.concat(F.lit(" (+"), (F.size(tokens) - 3).cast("string"), F.lit(" more)"))
    return F.when(F.size(tokens) == 0, "none").when(F.size(tokens) > 3, F.concat(F.array_join(F.slice(ordered, 1, 3), ", "), more)).otherwise(F.array_join(ordered, ", "))


def dates(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"^(19|20)\d{2}$") | t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"))


def page_range(text: Column) -> Column:
    """(low, high) of ``N`` or ``N-M`` with an optional p; null where the range is none."""
    bare = F.regexp_replace(stripped(text), "^p", "")
    one, two = F.regexp_extract(bare, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 1), F.regexp_extract(bare, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 2)
    low, high = F.nullif(one, F.lit("")).cast("int"), F.coalesce(F.nullif(two, F.lit("")), F.nullif(one, F.lit(""))).cast("int")
    return F.when((low >= 1) & (high >= low), F.struct(low.alias("low"), high.alias("high")))


def child_path(parent: Column, low: Column, high: Column) -> Column:
    return F.concat(parent, F.lit("#p"), low.cast("string"), F.lit("-"), high.cast("string"))


def child_parent(path: Column) -> Column:
    """The parent of a slice's path, or nothing."""
    return F.regexp_extract(path, r"(?s)^(.*)#p-?\d+-[+-]?\d+$", 1)


SIDECARS = (".textloom-transcription.md", ".textloom-regions.json")


def generated(path: Column, suffixes=SIDECARS) -> Column:
    """Whether a path is the engine's own output."""
    return F.greatest(*(path.endswith(s) for s in suffixes), F.lit(False))


# fixed values: what a document can be, and other names for that
KINDS = ("deed", "survey", "agreement", "correspondence", "court filing", "certification", "analysis", "notes", "commercial", "other")
KIND_NAMES = {
    "letter": "correspondence",
    "letters": "correspondence",
    "email": "correspondence",
    "e-mail": "correspondence",
    "memo": "correspondence",
    "memorandum": "correspondence",
    "notice": "correspondence",
    "contract": "agreement",
    "lease": "agreement",
    "purchase agreement": "agreement",
    "addendum": "agreement",
    "amendment": "agreement",
    "plat": "survey",
    "map": "survey",
    "record of survey": "survey",
    "title": "deed",
    "conveyance": "deed",
    "easement": "deed",
    "pleading": "court filing",
    "motion": "court filing",
    "complaint": "court filing",
    "petition": "court filing",
    "declaration": "court filing",
    "order": "court filing",
    "filing": "court filing",
    "certificate": "certification",
    "affidavit": "certification",
    "permit": "certification",
    "report": "analysis",
    "assessment": "analysis",
    "inspection": "analysis",
    "study": "analysis",
    "timeline": "notes",
    "transcript": "notes",
    "call transcript": "notes",
    "summary": "notes",
    "worklist": "notes",
    "checklist": "notes",
    "packet": "notes",
    "witness list": "notes",
    "working document": "notes",
    "work product": "notes",
    "log": "notes",
    "invoice": "commercial",
    "receipt": "commercial",
    "bill": "commercial",
    "statement": "commercial",
    "work order": "commercial",
    "estimate": "commercial",
    "quote": "commercial",
    "listing": "commercial",
    "mls listing": "commercial",
    "advertisement": "commercial",
}


def normal_kind(name: Column) -> Column:
    """One of KINDS, or null."""
    bare = F.regexp_replace(F.lower(stripped(name)), r"^\.+|\.+$", "")
    table = {k: k for k in KINDS} | KIND_NAMES
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[bare]


def caption_fault(name: Column, summary: Column, kind: Column) -> Column:
    """The first thing that is wrong with a caption, or null."""
    title, told = flat(name), stripped(summary)
    return (
        F.when(title == "", "name is empty").when(F.length(title) > 200, "name is too long").when(F.length(told) < 40, "summary says nothing")
        .when(F.length(told) > 2500, "summary is too long").when(normal_kind(kind).isNull(), "kind is unknown")
    )


def caption_text(name: Column, summary: Column, kind: Column, source: Column, model: Column) -> Column:
    """What is indexed for a caption: a description that says it is one; nothing for an empty caption."""
    who = F.when(source == "person", "recorded by a person").otherwise(F.concat(F.lit("generated by "), F.coalesce(model, F.lit(""))))
    part = lambda head, x, tail="\n": F.when(x != "", F.concat(F.lit(head), x, F.lit(tail))).otherwise("")
    whole = F.concat(F.lit("[what this document is — a description, "), who, F.lit("; NOT the document's own words]\n"), part("NAME: ", name), part("KIND: ", kind), part("\n", summary))
    return F.when((stripped(name) == "") & (stripped(summary) == ""), "").otherwise(whole)


def figures(text: Column) -> Column:
    """The descriptions of all figure marks of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[FIGURE:\s*([^\]]*)\]"), 1)


def json_object(text: Column) -> Column:
    """From the first brace to the last, of an answer that may be fenced."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def engine_summary(engines: Column) -> Column:
    """``name×n`` of an array of engine names, in order."""
    names = F.array_sort(F.array_distinct(engines))
    return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("×"), F.size(F.filter(engines, lambda e: e == n)).cast("string"))), ", ")


# fixed values: how machines' names begin
MACHINES = ("ocr-", "text-layer", "agent-", "attest-", "textloom")


def machine_author(name: Column) -> Column:
    """Whether a ruling's author is no person: nobody, or a name with a machine's prefix."""
    bare = F.coalesce(name, F.lit(""))
    return (bare == "") | F.greatest(*(bare.startswith(p) for p in MACHINES))


def paragraphs(text: Column) -> Column:
    """(from, to, text) of each paragraph: blank lines part them, white space at their ends is left out; offsets are code points."""
    pieces = F.split(text, r"\n[ \t\r]*\n\s*")
    found = F.aggregate(
        pieces,
        F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<struct<from:int,to:int,text:string>>)").alias("out")),
        lambda s, p: F.struct(
            (_place(text, p, s["at"]) + F.length(stripped(p))).cast("int").alias("at"),
            F.when(stripped(p) == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct((_place(text, p, s["at"]) - 1).cast("int").alias("from"), (_place(text, p, s["at"]) - 1 + F.length(stripped(p))).cast("int").alias("to"), stripped(p).alias("text"))))).alias("out"),
        ),
    )
    return found["out"]


def _place(text: Column, part: Column, start: Column) -> Column:
    return F.call_function("locate", stripped(part), text, start)
