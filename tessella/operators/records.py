"""Native record graphs: resolution, reference texts, categories, inventory, emission and compilation.

A record table has ``doc, occ, id, kind, label, segments, arg1, arg2, trigger, role_list, valid``; kinds are T, R, E and AUX.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import base_role, canonical_json
from tessella.session import materialize, release

#: Tables of records fallen in a round that are kept apart.
MOST_FRONTS = 8

# The configured label vocabulary.
ENTITY_LABELS = ("Characterization", "Material", "Property", "Element", "Process", "Value", "SC", "Main")
EVENT_LABELS = ("Doping",)
RELATION_LABELS = ("Condition", "Equivalent", "Target")
ROLES = ("Dopant", "Site")
PER_KIND = {"T": ENTITY_LABELS + EVENT_LABELS, "R": RELATION_LABELS, "E": EVENT_LABELS}


def supported(kind: Column, label: Column, labels: dict[str, tuple[str, ...]] = PER_KIND) -> Column:
    out = F.lit(True)
    for k, known in labels.items():
        out = F.when(kind == k, F.coalesce(label.isin(*known), F.lit(False))).otherwise(out)
    return out


def category(kind: Column, label: Column) -> Column:
    """The configured label, else OTHER_NATIVE."""
    return F.when(supported(kind, label), label).otherwise(F.lit("OTHER_NATIVE"))


def reference_text(text: Column, segments: Column) -> Column:
    """The segments' texts joined by blanks, in written order."""
    return F.array_join(F.transform(segments, lambda s: F.substring(text, s["a"] + 1, s["b"] - s["a"])), " ")


def references(df: DataFrame) -> DataFrame:
    """Endpoint rows ``doc, occ, kind, ref, as_trigger`` of valid R and E records."""
    e = df.where("valid and kind in ('R', 'E')")
    ends = F.when(F.col("kind") == "R", F.array(*[F.struct(F.col(a).alias("ref"), F.lit(False).alias("as_trigger")) for a in ("arg1", "arg2")])).otherwise(
        F.concat(F.array(F.struct(F.col("trigger").alias("ref"), F.lit(True).alias("as_trigger"))), F.transform(F.coalesce("role_list", F.array().cast("array<struct<role:string,target:string>>")), lambda r: F.struct(r["target"].alias("ref"), F.lit(False).alias("as_trigger"))))
    )
    return e.select("doc", "occ", "kind", F.inline(ends))


def resolved(df: DataFrame, gold: bool, max_rounds: int = 1000) -> DataFrame:
    """Adds ``issue``, and clears ``valid`` where there is one.

    In turn: an id shared within a document (``*`` aside) makes all its records invalid; in predictions so does a label or a
    role outside the vocabulary; then R and E records whose endpoint is missing, invalid or neither T nor E, and E records whose trigger is no T,
    become invalid until nothing changes, so that cycles of sound events stay. Each round is one anti-join on the ids that
    fell in the round before.
    """
    lone = F.when(F.col("id").isNull() | (F.col("id") == "*"), F.concat(F.lit("*"), F.col("occ").cast("string"))).otherwise(F.col("id"))
    same = F.count("*").over(W.partitionBy("doc", "_id"))
    issue = F.when(~F.coalesce("valid", F.lit(False)), F.coalesce("issue", F.lit("malformed"))) if "issue" in df.columns else F.when(~F.coalesce("valid", F.lit(False)), F.lit("malformed"))
    d = df.withColumn("_id", lone).withColumn("_n", same)
    issue = issue.when(F.col("_n") > 1, F.lit("duplicate_identifier"))
    if not gold:
        odd = F.exists(F.coalesce("role_list", F.array().cast("array<struct<role:string,target:string>>")), lambda r: ~base_role(r["role"], ROLES).isin(*ROLES))
        issue = issue.when(~supported(F.col("kind"), F.col("label")), F.lit("unsupported_prediction_label")).when((F.col("kind") == "E") & odd, F.lit("unsupported_prediction_role"))
    d = materialize(d.withColumn("issue", issue).withColumn("valid", F.col("issue").isNull()).drop("_id", "_n"), "records")
    good = d.where("valid and kind in ('T', 'E')").select("doc", F.col("id").alias("ref"), F.col("kind").alias("ref_kind"))
    refs = materialize(references(d).join(good, ["doc", "ref"], "left").join(d.select("doc", "occ", "id"), ["doc", "occ"]), "refs")
    # the first to fall: endpoints not there, triggers that are no T
    fallen = materialize(
        refs.where("ref_kind is null or (as_trigger and ref_kind <> 'T')").groupBy("doc", "occ", "kind", "id").agg(F.bool_or(F.col("ref_kind").isNull()).alias("gone")).select("doc", "occ", "kind", "id", F.when(F.col("gone"), F.lit("dangling_or_invalid_dependency")).otherwise(F.lit("event_trigger_not_T")).alias("why")), "fallen"
    )
    fronts = [fallen]
    for _ in range(max_rounds):
        if not fronts[-1].where("kind = 'E'").take(1):
            break
        hit = refs.join(fronts[-1].where("kind = 'E'").select("doc", F.col("id").alias("ref")), ["doc", "ref"], "left_semi").select("doc", "occ", "kind", "id").distinct()
        for f in fronts:
            hit = hit.join(f, ["doc", "occ"], "left_anti")
        fronts.append(materialize(hit.withColumn("why", F.lit("dangling_or_invalid_dependency")), "fallen"))
        if len(fronts) > MOST_FRONTS:
            whole = materialize(reduce(DataFrame.unionByName, fronts[:-1]), "fallen")
            for f in fronts[:-1]:
                release(f)
            fronts = [whole, fronts[-1]]
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    release(refs)
    fallen = reduce(DataFrame.unionByName, fronts)
    out = d.join(fallen.select("doc", "occ", "why"), ["doc", "occ"], "left")
    return out.withColumn("issue", F.coalesce("issue", "why")).withColumn("valid", F.col("issue").isNull()).drop("why")


def mention_key(label: Column, segments: Column) -> Column:
    """A mention's identity: label and segments in written order."""
    return F.concat_ws(" ", label, F.array_join(F.transform(segments, lambda s: F.concat_ws("-", s["a"].cast("string"), s["b"].cast("string"))), ";"))


def endpoint_keys(df: DataFrame) -> DataFrame:
    """``doc, id, key``: a T's mention, and for an E that of its trigger."""
    t = df.where("kind = 'T' and valid").select("doc", "id", mention_key(F.col("label"), F.col("segments")).alias("key"))
    e = df.where("kind = 'E' and valid").select("doc", "id", F.col("trigger").alias("t")).join(t.select("doc", F.col("id").alias("t"), "key"), ["doc", "t"]).select("doc", "id", "key")
    return t.unionByName(e)


def relation_keys(df: DataFrame) -> DataFrame:
    """R records with their trigger-projected ``key`` (null for invalid ones)."""
    k = endpoint_keys(df)
    r = df.where("kind = 'R'").select("doc", "occ", "label", "arg1", "arg2", "valid")
    one = lambda a: k.select("doc", F.col("id").alias(a), F.col("key").alias(f"{a}_key"))
    return r.join(one("arg1"), ["doc", "arg1"], "left").join(one("arg2"), ["doc", "arg2"], "left").withColumn("key", F.when(F.col("valid"), F.concat_ws("|", "label", "arg1_key", "arg2_key")))


def signature_warnings(rel: DataFrame, known: DataFrame, signature: list[str]) -> DataFrame:
    """Relations whose (label, head type, tail type) never occurs in the known ones."""
    return rel.join(known.select(*signature).distinct(), signature, "left_anti")


def unique_mentions(df: DataFrame) -> DataFrame:
    """T records with ``mention``: the number of their identity within the document, in order of first occurrence."""
    key = mention_key(F.col("label"), F.col("segments"))
    t = df.where("kind = 'T' and valid").withColumn("key", key)
    first = t.groupBy("doc", "key").agg(F.min("occ").alias("first")).withColumn("mention", F.row_number().over(W.partitionBy("doc").orderBy("first")) - 1)
    return t.join(first.select("doc", "key", "mention"), ["doc", "key"])


def inventory(df: DataFrame) -> DataFrame:
    """Counts of a native schema, as ``what, name, n``: records, labels, roles, repeated mentions and relations, several labels of a pair, shared triggers."""
    rows = [
        df.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("records").alias("what"), "name", "n"),
        df.where("valid").groupBy(F.concat_ws(":", "kind", "label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("labels").alias("what"), "name", "n"),
        df.where("valid and kind = 'E'").select(F.inline("role_list")).groupBy(F.col("role").alias("name")).agg(F.count("*").alias("n")).select(F.lit("roles").alias("what"), "name", "n"),
    ]
    t = df.where("valid and kind = 'T'").groupBy("doc", mention_key(F.col("label"), F.col("segments")).alias("k")).agg((F.count("*") - 1).alias("n"))
    r = df.where("valid and kind = 'R'")
    again = r.groupBy("doc", "label", "arg1", "arg2").agg((F.count("*") - 1).alias("n"))
    several = r.groupBy("doc", "arg1", "arg2").agg((F.countDistinct("label") - 1).alias("n"))
    shared = df.where("valid and kind = 'E'").groupBy("doc", "trigger").agg((F.count("*") - 1).alias("n"))
    for name, x in (("repeated_mentions", t), ("repeated_relations", again), ("further_labels_of_a_pair", several), ("further_events_of_a_trigger", shared)):
        rows.append(x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("excess").alias("what"), F.lit(name).alias("name"), "n"))
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


def motif_chains(df: DataFrame, first: str = "Equivalent", second: str = "Condition") -> DataFrame:
    """Pairs of relations in which the first's tail is the second's head, by document."""
    r = df.where("valid and kind = 'R'")
    a = r.where(F.col("label") == first).select("doc", F.col("arg1").alias("a"), F.col("arg2").alias("m"))
    b = r.where(F.col("label") == second).select("doc", F.col("arg1").alias("m"), F.col("arg2").alias("b"))
    return a.join(b, ["doc", "m"]).select("doc", "a", "m", "b")


def emitted_lines(mentions: DataFrame, pairs: DataFrame, relation_t: float, role_t: float, doc: str = "doc") -> DataFrame:
    """Native lines from mentions and pair probabilities: ``doc, family, number, line``.

    ``mentions(doc, i, type, spans)`` are numbered from 0; ``pairs(doc, h, t, label, p)``. Each Doping mention gives one event with its
    roles in order of role and target; relations are numbered in order of head, tail and label, and name a trigger's event in place of its mention.
    """
    m = mentions.withColumn("e", F.when(F.col("type") == "Doping", F.sum((F.col("type") == "Doping").cast("int")).over(W.partitionBy(doc).orderBy("i").rowsBetween(W.unboundedPreceding, 0))))
    t = m.select(doc, F.lit("T").alias("family"), (F.col("i") + 1).cast("long").alias("number"), F.concat(F.lit("T"), F.col("i") + 1, F.lit("\t"), "type", F.lit(" "), "spans").alias("line"))
    role = pairs.where(F.col("label").isin(*ROLES) & (F.col("p") >= role_t)).groupBy(doc, F.col("h").alias("i")).agg(F.array_sort(F.collect_list(F.struct("label", "t"))).alias("r"))
    text = F.transform(F.coalesce("r", F.array().cast("array<struct<label:string,t:int>>")), lambda x: F.concat(F.lit(" "), x["label"], F.lit(":T"), x["t"] + 1))
    e = m.where("e is not null").join(role, [doc, "i"], "left").select(doc, F.lit("E").alias("family"), F.col("e").cast("long").alias("number"), F.concat(F.lit("E"), F.col("e"), F.lit("\tDoping:T"), F.col("i") + 1, F.array_join(text, "")).alias("line"))
    name = m.select(doc, "i", F.coalesce(F.concat(F.lit("E"), F.col("e")), F.concat(F.lit("T"), F.col("i") + 1)).alias("name"))
    r = pairs.where(F.col("label").isin(*RELATION_LABELS) & (F.col("p") >= relation_t))
    r = r.join(name.withColumnsRenamed({"i": "h", "name": "head"}), [doc, "h"]).join(name.withColumnsRenamed({"i": "t", "name": "tail"}), [doc, "t"])
    r = r.withColumn("number", F.row_number().over(W.partitionBy(doc).orderBy("h", "t", "label")).cast("long"))
    r = r.select(doc, F.lit("R").alias("family"), "number", F.concat(F.lit("R"), F.col("number"), F.lit("\t"), "label", F.lit(" Arg1:"), "head", F.lit(" Arg2:"), "tail").alias("line"))
    return t.unionByName(e).unionByName(r)


_GRAPH = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("family", "payload", "declared_label", "fault")]))


def _anchor(text: str, span: object) -> tuple[int, int]:
    if not isinstance(span, dict) or set(span) != {"quote", "occurrence"} or not isinstance(span["quote"], str) or not span["quote"] or type(span["occurrence"]) is not int or span["occurrence"] < 0:
        raise ValueError("span")
    at = -1
    for _ in range(span["occurrence"] + 1):
        at = text.find(span["quote"], at + 1)
        if at < 0:
            raise ValueError("quote_not_there")
    return at, at + len(span["quote"])


def _atom(v: object, ends: str | None = None) -> str:
    import re

    pattern = rf"[{ends}][1-9][0-9]*" if ends else r"[^\s:;]+"
    if not isinstance(v, str) or not re.fullmatch(pattern, v):
        raise ValueError("atom")
    return v


_KEYS = {"T": {"id", "type", "spans"}, "R": {"id", "type", "head", "tail"}, "E": {"id", "type", "trigger", "roles"}}


def _line(item: object, family: str, text: str) -> str:
    if not isinstance(item, dict) or set(item) != _KEYS[family]:
        raise ValueError("closed_record")
    head = f"{_atom(item['id'], family)}\t{_atom(item['type'])}"
    if family == "T":
        if not isinstance(item["spans"], list) or not item["spans"]:
            raise ValueError("spans")
        return head + " " + ";".join("{} {}".format(*_anchor(text, s)) for s in item["spans"])
    if family == "R":
        return f"{head} Arg1:{_atom(item['head'], 'TE')} Arg2:{_atom(item['tail'], 'TE')}"
    roles = item["roles"]
    if not isinstance(roles, list) or any(not isinstance(r, dict) or set(r) != {"type", "target"} for r in roles):
        raise ValueError("roles")
    return " ".join([f"{head}:{_atom(item['trigger'], 'T')}", *[f"{_atom(r['type'])}:{_atom(r['target'], 'TE')}" for r in roles]])


@F.pandas_udf(_GRAPH)
def compiled(text: pd.Series, graph: pd.Series) -> pd.Series:
    """Emissions of a JSON graph with the lists entities, relations and events; null if the whole artifact fails, which isn't an empty list.

    A malformed record gives exactly one emission of its family that the grammar refuses: its id alone if it has a lawful one, else its JSON.
    """
    import re

    from tessella.functions.text import _json_fault

    names = {"entities": "T", "relations": "R", "events": "E"}

    def one(source: str | None, raw: str | None):
        if source is None or raw is None or _json_fault(raw):
            return None
        g = json.loads(raw)
        if not isinstance(g, dict) or set(g) != set(names) or not all(isinstance(v, list) for v in g.values()):
            return None
        out = []
        for name, items in g.items():
            for item in items:
                label = item.get("type") if isinstance(item, dict) and isinstance(item.get("type"), str) else None
                try:
                    out.append({"family": names[name], "payload": _line(item, names[name], source), "declared_label": label, "fault": None})
                except ValueError as e:
                    own = item.get("id") if isinstance(item, dict) else None
                    keep = own if isinstance(own, str) and re.fullmatch(r"[TRE][1-9][0-9]*", own) else json.dumps(item, ensure_ascii=True, separators=(",", ":"))
                    out.append({"family": names[name], "payload": keep, "declared_label": label, "fault": str(e)})
        return out

    return pd.Series([one(a, b) for a, b in zip(text, graph, strict=True)], dtype=object)


MOST_TICKETS = 12
_TICKET = "array<struct<family:string,operation:string,issue:string,recommendation:string,uncertainty:string,target_ids:array<string>,source_witnesses:array<struct<quote:string,occurrence:int>>>>"


def tickets(df: DataFrame, raw: str, key: list[str]) -> DataFrame:
    """Critic replies ``{"tickets": [...]}`` to one row per ticket with ``slot`` and ``status``.

    A reply that isn't sound JSON of that shape, or holds more than 12 tickets, fails as a whole: one row, ``slot`` null. A ticket with a part
    missing or empty stays, marked invalid; nothing is cut off.
    """
    sound = canonical_json(raw)
    body = F.from_json(F.coalesce(sound, F.lit("{}")), f"tickets {_TICKET}")
    parsed = df.select(*key, body["tickets"].alias("t"), sound.isNotNull().alias("json"))
    failed = F.when(~F.col("json"), "malformed").when(F.col("t").isNull(), "no_ticket_list").when(F.size("t") > MOST_TICKETS, "over_budget")
    p = parsed.withColumn("failure", failed)
    bad = p.where("failure is not null").select(*key, F.lit(None).cast("int").alias("slot"), F.lit(None).cast(_TICKET[6:-1]).alias("ticket"), F.col("failure").alias("status"))
    each = p.where("failure is null").select(*key, F.posexplode("t").alias("slot", "ticket"))
    text = [F.coalesce(F.col(f"ticket.{c}") != "", F.lit(False)) for c in ("family", "operation", "issue", "recommendation", "uncertainty")]
    ok = F.col("ticket.target_ids").isNotNull() & F.col("ticket.source_witnesses").isNotNull() & F.col("ticket.family").isin("T", "R", "E") & F.col("ticket.operation").isin("add", "delete", "revise")
    for t in text:
        ok = ok & t
    return each.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("invalid_ticket")).unionByName(bad)


def ticket_targets(rows: DataFrame, key: list[str], records: DataFrame, doc: str) -> DataFrame:
    """Each ticket's target ids with how many records of the document bear them; exactly one is what it must be."""
    t = rows.where("slot is not null").select(*key, "slot", F.explode_outer("ticket.target_ids").alias("target"))
    n = records.groupBy(doc, F.col("id").alias("target")).agg(F.count("*").alias("n"))
    return t.join(n, [doc, "target"], "left").withColumn("unique", F.coalesce(F.col("n") == 1, F.lit(False)))


def lossless(df: DataFrame, raw: str, key: list[str]) -> DataFrame:
    """Records as one JSON line each, the bytes in base64; null bytes stay null."""
    return df.select(*key, F.to_json(F.struct(*key, F.regexp_replace(F.base64(F.col(raw)), "[\r\n]", "").alias("raw_base64"))).alias("json"))


def restored(df: DataFrame, json_col: str = "json") -> DataFrame:
    """The bytes of :func:`lossless` lines."""
    return df.withColumn("raw", F.unbase64(F.get_json_object(json_col, "$.raw_base64")))




def document_scores(sides: DataFrame, by: list[str], budget: int | None = None) -> DataFrame:
    """``by, metric, tp, fp, fn`` of every document under all eight populations.

    ``sides`` has resolved records of both sides with ``gold``. Mentions and projected relations are multisets of keys; events and relations are
    matched as whole graphs, events also root by root. Invalid records count on their side and match nothing.
    """
    from tessella.operators import graph, score

    key = mention_key(F.col("label"), F.col("segments"))
    known = ENTITY_LABELS + EVENT_LABELS
    pops = {"entities_eight": ENTITY_LABELS, "triggers": EVENT_LABELS, "combined_text_bound": known}
    member = F.array(F.lit("text_bound_all_native"), *[F.when(F.col("label").isin(*v), F.lit(n)) for n, v in pops.items()])
    t = sides.where("kind = 'T'").select(*by, "gold", "valid", key.alias("key"), F.explode(F.filter(member, lambda x: x.isNotNull())).alias("metric"))
    rel = None
    for g in (False, True):
        r = relation_keys(sides.where(F.col("gold") == g).withColumn("doc", F.struct(*by)) if by != ["doc"] else sides.where(F.col("gold") == g))
        r = r.select(*([F.col("doc")] if by == ["doc"] else [F.col(f"doc.{c}").alias(c) for c in by]), F.lit(g).alias("gold"), "valid", "key", F.lit("relations_trigger_projected").alias("metric"))
        rel = r if rel is None else rel.unionByName(r)
    flat = t.unionByName(rel)
    sums = score.multiset_counts(flat.where("not gold"), flat.where("gold"), [*by, "metric", "key"], [*by, "metric"], valid="valid").select(*by, "metric", "tp", "fp", "fn")
    for family, name in (("E", "events_full_graph"), ("R", "relations_full_graph")):
        m = graph.match_documents(sides, by, family, budget or graph.BUDGET)
        sums = sums.unionByName(m.select(*by, F.lit(name).alias("metric"), "tp", "fp", "fn"))
        if family == "E":
            local = F.col("local_tp")
            sums = sums.unionByName(m.select(*by, F.lit("events_root_local_diagnostic").alias("metric"), local.alias("tp"), (F.col("tp") + F.col("fp") - local).alias("fp"), (F.col("tp") + F.col("fn") - local).alias("fn")))
    return sums


def population_scores(scores: DataFrame, inventory_: DataFrame, by: list[str]) -> DataFrame:
    """Scores of a declared population of documents summed by metric; a document without any record counts nothing, one that isn't declared is an error.

    Documents whose search exceeded its budget are counted as ``faults``; the sums of a metric with any are null, for they would be incomplete.
    """
    from tessella.operators.checks import require_empty

    require_empty(scores.select(*by).distinct().join(inventory_.select(*by), by, "left_anti"), "documents outside the population")
    n = inventory_.select(*by).distinct().count()
    whole = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c)).alias(c)
    return scores.groupBy("metric").agg(whole("tp"), whole("fp"), whole("fn"), F.count_if(F.col("tp").isNull()).alias("faults")).withColumn("documents", F.lit(n).cast("long"))


def prompt(parts: list[tuple[str, Column]], data: Column) -> Column:
    """Headed text parts and one JSON part, null parts left out."""
    return F.concat_ws("\n\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}\n"), c)) for name, c in parts], F.to_json(data))


def endpoint_form(text: Column, begin: Column, end: Column) -> Column:
    """A span as its text and the number of its occurrence (from 0, overlaps counted): the one that begins where the span does."""
    from tessella.functions.text import occurrences

    quote = F.substring(text, begin + 1, end - begin)
    return F.struct(quote.alias("text"), (F.array_position(occurrences(text, quote), begin) - 1).cast("int").alias("occurrence"))


def endpoint_span(text: Column, quote: Column, occurrence: Column) -> Column:
    """The span of a text's occurrence, null where there is none: the inverse of :func:`endpoint_form`."""
    from tessella.functions.text import nth_occurrence

    at = nth_occurrence(text, quote, occurrence)
    return F.when(at.isNotNull(), F.struct(at.alias("begin"), (at + F.length(quote)).alias("end")))
