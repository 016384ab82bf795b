"""Attestations: a log of rulings on the units of a reading, folded into the state of each unit.

A log has path, seq, unit, kind, blanket, text, label, by and statement.  Kinds:
confirmed, corrected, affirmed, unclear, unsupported, retract, resegment.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("confirmed", "corrected", "affirmed", "unclear", "unsupported")


def fault(kind: Column, by: Column, blanket: Column, unit: Column, adds: Column | None = None, retires: Column | None = None) -> Column:
    """The first thing that is wrong with an entry, or null."""
    nothing = (F.size(F.coalesce(adds, F.array())) + F.size(F.coalesce(retires, F.array())) == 0) if adds is not None and retires is not None else F.lit(False)
    return (
        F.when(~F.coalesce(kind.isin(*KINDS, "retract", "resegment"), F.lit(False)), "unknown kind").when(F.coalesce(by, F.lit("")) == "", "no author")
        .when((kind == "resegment") & nothing, "a resegment that changes nothing")
        .when((kind != "resegment") & blanket & ~kind.isin("affirmed", "retract"), "this kind cannot be blanket")
        .when((kind != "resegment") & ~blanket & (F.coalesce(unit, F.lit("")) == ""), "no unit")
    )


def states(units: DataFrame, log: DataFrame) -> DataFrame:
    """(path, unit, ord, kind, swept, by, seq, text, label): where each unit stands after its document's log.

    The last ruling of a unit holds; a retract takes it back, its words too.  A
    blanket affirmation covers the units that nothing holds at its time, and a
    blanket retract frees those again, nothing else.  Words that a ruling leaves
    empty stay as they were.  ``kind`` is empty for an untouched unit.  Documents
    whose log cuts units anew need ``resegmented`` first.
    """
    own = log.where("not blanket and kind <> 'resegment'")
    reset = own.where("kind = 'retract'").groupBy("path", "unit").agg(F.max("seq").alias("reset"))
    after = own.where("kind <> 'retract'").join(reset, ["path", "unit"], "left").where("reset is null or seq > reset")
    word = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq"))).alias(c)
    ruled = after.groupBy("path", "unit").agg(F.max_by(F.struct("kind", "by", "seq"), "seq").alias("r"), word("text"), word("label"))
    freed = log.where("blanket and kind = 'retract'").groupBy("path").agg(F.max("seq").alias("freed"))
    told = units.select("path", "unit", "ord", F.col("text").alias("own_text"), F.col("label").alias("own_label")).join(ruled, ["path", "unit"], "left").join(reset, ["path", "unit"], "left").join(freed, "path", "left")
    told = told.withColumn("open_from", F.when(F.col("r").isNull(), F.greatest(F.coalesce("reset", F.lit(-1)), F.coalesce("freed", F.lit(-1)))))
    # the first sweep after a unit was last free: sweeps and units in one order, from the end
    sweeps = log.where("blanket and kind = 'affirmed'").select("path", F.col("seq").alias("at"), F.struct("seq", "by").alias("sweep"), F.lit(None).cast("string").alias("unit"))
    points = told.where("open_from is not null").select("path", F.col("open_from").alias("at"), F.lit(None).cast(sweeps.schema["sweep"].dataType).alias("sweep"), "unit")
    order = Window.partitionBy("path").orderBy(F.desc("at"), F.col("unit").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = sweeps.unionByName(points).withColumn("first", F.last("sweep", ignorenulls=True).over(order)).where("unit is not null and first is not null").select("path", "unit", "first")
    met = told.join(swept, ["path", "unit"], "left")
    kind = F.coalesce("r.kind", F.when(F.col("first").isNotNull(), "affirmed"), F.lit(""))
    return met.select("path", "unit", "ord", kind.alias("kind"), (F.col("r").isNull() & F.col("first").isNotNull()).alias("swept"), F.coalesce("r.by", "first.by", F.lit("")).alias("by"), F.coalesce("r.seq", "first.seq").alias("seq"), F.coalesce("text", "own_text").alias("text"), F.coalesce("label", "own_label").alias("label"))


def orphans(units: DataFrame, log: DataFrame) -> DataFrame:
    """Rulings on units that the reading does not have."""
    return log.where("not blanket and kind <> 'resegment'").join(units.select("path", "unit"), ["path", "unit"], "left_anti")


def stats(units: DataFrame, log: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """A row a document: units by kind, orphaned rulings, and the sweep that stands with its author, statement and time.

    A log without the column ``at`` has no times.
    """
    found = states(units, log) if found is None else found
    counts = found.groupBy("path").agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.count_if(F.col("kind") == "").alias("untouched"))
    lost = orphans(units, log).groupBy("path").agg(F.count("*").alias("orphaned"))
    at = F.col("at") if "at" in log.columns else F.lit(None).cast("string").alias("at")
    blanket = log.where("blanket").groupBy("path").agg(F.max_by(F.struct("kind", "by", "statement", at), "seq").alias("b")).where("b.kind = 'affirmed'")
    blanket = blanket.select("path", F.col("b.by").alias("swept_by"), F.col("b.statement").alias("statement"), F.col("b.at").alias("swept_at"))
    return counts.join(lost, "path", "left").join(blanket, "path", "left").withColumn("orphaned", F.coalesce("orphaned", F.lit(0)))


def provenance(found: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(path, sentence): what must stand beside anything derived from a document, from its ``stats``.

    Of ``documents`` (path) those that have no unit are told to have no reading.
    """
    if documents is not None:
        found = documents.select("path").distinct().join(found, "path", "left")
    one = F.col("confirmed") + F.col("corrected") + F.col("unclear") + F.col("unsupported")
    n = lambda c: (c if isinstance(c, Column) else F.col(c)).cast("string")
    parts = F.array_compact(F.array(F.when(one > 0, F.concat(n(one), F.lit(" checked one by one"))), F.when(F.col("affirmed") > 0, F.concat(n("affirmed"), F.lit(" accepted by affirmation")))))
    quote = F.when(F.col("affirmed") == 0, "").when(F.coalesce("statement", F.lit("")) != "", F.concat(F.lit(' It reads: "'), "statement", F.lit('" by '), F.coalesce("swept_by", F.lit("")), F.when(F.coalesce("swept_at", F.lit("")) != "", F.concat(F.lit(" on "), "swept_at")).otherwise(""), F.lit("."))).otherwise(" Its terms were not recorded.")
    complete = F.concat(F.lit("Review complete: "), F.array_join(parts, ", "), F.lit(" of "), n("total"), F.lit(" units."), quote)
    partly = F.concat(F.lit("Review incomplete: "), n(one), F.lit(" checked one by one, "), n("affirmed"), F.lit(" accepted by affirmation, "), n("untouched"), F.lit(" of "), n("total"), F.lit(" units untouched."))
    words = F.when(F.col("corrected") == 0, " No words were corrected by a person.").otherwise(F.concat(F.lit(" Words corrected by a person in "), n("corrected"), F.lit(" of "), n("total"), F.lit(" units.")))
    lost = F.when(F.col("orphaned") > 0, F.concat(F.lit(" "), n("orphaned"), F.lit(" rulings match no unit and are not counted."))).otherwise("")
    told = F.concat(F.when(F.col("untouched") == 0, complete).otherwise(partly), words, lost)
    return found.select("path", F.when(F.coalesce("total", F.lit(0)) == 0, "No reading of this document by a machine is recorded.").otherwise(told).alias("sentence"))


class Fold:
    """One document's units in order and where they stand, changed entry by entry of its log; ``lost`` are entries on units it never had."""

    def __init__(self, units: list[dict]):
        self.order: list[dict] = []
        self.known: set[str] = set()
        self.lost: list[dict] = []
        self.begin(units)

    @staticmethod
    def _fresh(unit: dict, authored: bool = False) -> dict:
        return {**unit, "own_text": unit["text"], "own_label": unit["label"], "kind": "", "swept": False, "by": "", "seq": None, "authored": authored}

    def begin(self, units: list[dict]) -> None:
        """The document's own units."""
        self.order += [self._fresh(u) for u in units]
        self.known |= {u["unit"] for u in units}

    def state(self) -> dict:
        """What ``restored`` takes to go on."""
        return {"order": self.order, "known": sorted(self.known)}

    @classmethod
    def restored(cls, state: dict) -> "Fold":
        fold = cls([])
        fold.order, fold.known = state["order"], set(state["known"])
        return fold

    def apply(self, e: dict) -> None:
        free = lambda s: s.update(kind="", swept=False, by="", seq=None, text=s["own_text"], label=s["own_label"])
        here = {s["unit"]: s for s in self.order}
        if e["kind"] == "resegment":
            gone = set(e.get("retires") or [])
            places = [i for i, s in enumerate(self.order) if s["unit"] in gone]
            add = [self._fresh(u, True) for u in e.get("adds") or [] if u["unit"] not in here]
            self.known |= {u["unit"] for u in add}
            kept = [s for s in self.order if s["unit"] not in gone]
            at = min(min(places), len(kept)) if places else len(kept)
            self.order = kept[:at] + add + kept[at:]
        elif e["blanket"]:
            for s in self.order:
                if e["kind"] == "retract" and s["swept"]:
                    free(s)
                elif e["kind"] == "affirmed" and not s["kind"]:
                    s.update(kind="affirmed", swept=True, by=e["by"], seq=e["seq"])
        elif e["unit"] not in here:
            if e["unit"] not in self.known:
                self.lost.append(e)
        elif e["kind"] == "retract":
            free(here[e["unit"]])
        else:
            s = here[e["unit"]]
            s.update(kind=e["kind"], swept=False, by=e["by"], seq=e["seq"], text=e["text"] or s["text"], label=e["label"] or s["label"])


def resolve(units: list[dict], log: list[dict]) -> tuple[list[dict], list[dict]]:
    """The whole fold of one document's log in plain Python, resegments included: its units in order, and orphans."""
    fold = Fold(units)
    for e in log:
        fold.apply(e)
    return fold.order, fold.lost


def resegmented(units: DataFrame, log: DataFrame) -> DataFrame:
    """(path, unit, ord, kind, swept, by, seq, text, label) for documents whose log cuts units anew, each folded in one group.

    The log also has ``retires`` (array of units) and ``adds`` (array of unit, text, label).
    """
    marked = log.where("kind = 'resegment'").select("path").distinct()
    left = units.join(marked, "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "unit", "text", "label"))).alias("units"))
    right = log.join(marked, "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "unit", "kind", "blanket", "text", "label", "by", "retires", "adds"))).alias("log"))

    def run(batches):
        for batch in batches:
            rows = []
            for path, own, entries in zip(batch["path"], batch["units"], batch["log"]):
                plain = [{**e, "adds": [dict(a) for a in (e["adds"] if e["adds"] is not None else [])], "retires": list(e["retires"]) if e["retires"] is not None else []} for e in entries]
                order, _ = resolve([dict(u) for u in own], plain)
                rows += [(path, s["unit"], i, s["kind"], s["swept"], s["by"], s["seq"], s["text"], s["label"]) for i, s in enumerate(order)]
            yield pd.DataFrame(rows, columns=["path", "unit", "ord", "kind", "swept", "by", "seq", "text", "label"])

    return left.join(right, "path").mapInPandas(run, "path string, unit string, ord int, kind string, swept boolean, by string, seq long, text string, label string")


def _number(x: float) -> str:
    return np.format_float_positional(x, trim="-")


def unit_id(unit: dict) -> str:
    """A unit's content address: a digest over length-prefixed fields, after a hint of where it is.

    ``unit`` has parent, label, text, evidence, and one of time (start, end), area
    (page, x, y, w, h, rotation, dpi) and span (from, to).
    """
    fields, hint = [("parent", unit.get("parent") or "")], "u-"
    if unit.get("time"):
        t = unit["time"]
        fields += [("time.start", _number(t["start"])), ("time.end", _number(t["end"]))]
        hint = f"t{t['start']:.2f}-"
    elif unit.get("area"):
        a = unit["area"]
        fields += [("area.page", str(a["page"])), *((f"area.{k}", _number(a[k])) for k in "xywh"), ("area.rotation", str(a["rotation"])), ("area.dpi", str(a["dpi"]))]
        hint = f"p{a['page']}-"
    elif unit.get("span"):
        s = unit["span"]
        fields += [("span.from", str(s["from"])), ("span.to", str(s["to"]))]
        hint = f"b{s['from']}-"
    fields += [(k, unit.get(k) or "") for k in ("label", "text", "evidence")]
    digest = hashlib.sha256(b"".join(f"{k}:{len(v.encode())}:{v}".encode() for k, v in fields))
    return hint + digest.hexdigest()[:16]


def span_unit_id(parent: Column, low: Column, high: Column, label: Column, text: Column) -> Column:
    """``unit_id`` of units located by a span, as an expression."""
    part = lambda name, v: F.concat(F.lit(f"{name}:"), F.octet_length(v).cast("string"), F.lit(":"), v)
    fields = [("parent", parent), ("span.from", low.cast("string")), ("span.to", high.cast("string")), ("label", label), ("text", text), ("evidence", F.lit(""))]
    whole = F.concat(*(part(k, F.coalesce(v, F.lit(""))) for k, v in fields))
    return F.concat(F.lit("b"), low.cast("string"), F.lit("-"), F.substring(F.sha2(whole, 256), 1, 16))


def sealed(units: list[dict]) -> list[dict]:
    """Units with content addresses in ``id``; a parent must come before what it holds, and is named by its address.

    Two equal claims are one too many: that is an error.
    """
    names, seen, out = {}, set(), []
    for u in units:
        parent = u.get("parent") or ""
        if parent and parent not in names:
            raise ValueError(f"{parent} comes after a unit that it holds")
        made = {**u, "parent": names.get(parent, "")}
        made["id"] = unit_id(made)
        if made["id"] in seen:
            raise ValueError(f"the unit {made['id']} is there twice")
        seen.add(made["id"])
        if u.get("id"):
            names[u["id"]] = made["id"]
        out.append(made)
    return out


def evidence_holds(content: Column, digest: Column) -> Column:
    """Whether an artifact has the digest that a unit was sealed with."""
    return F.sha2(content, 256) == F.lower(digest)


def projected(table: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """A projection with all rows of ``documents`` (path) replaced by ``rows``."""
    return table.join(documents.select("path").distinct(), "path", "left_anti").unionByName(rows)
