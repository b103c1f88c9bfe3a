"""From packet texts to a ranked queue: the stages as one chain of transforms.

packets (doc_id, text) -> items -> own blocks -> applications -> scoped signal events and dates -> leads -> queue.
Each stage adds columns or rows and none collects; the unit of parallel work is a document, then a
document's item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import constants as K
from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.operators import evidence as E
from quarry.operators import extract as X
from quarry.operators import leads as L
from quarry.operators import rows as R
from quarry.operators import signals as S
from quarry.session import load

#: Headings that open an item of an agenda.
ITEM = r"(?:ITEM|Item) [0-9]+\b"
#: What tells of a signal, as kind and pattern; the last alternative of a kind is this library's wider reading.
PATTERNS = (
    ("recommended_denial", r"(?i)\b(?:was|were)\s+recommended\s+denial\b|\brecommended\s+denial\s+by\s+the\s+planning\s+commission\b|\bstaff\s+(?:recommended|recommends)\s+denial\s+of\b|\brecommend(?:ed|s)? (?:a )?denial\b"),
    ("denied", r"(?i)\bultimately\s+denied\b|\b(?:application|request)\s+was\s+denied\b|\bdenied\s+by\s+the\s+(?:municipal\s+)?council\b|\b(?:was|were|recommended and ultimately) denied\b"),
    ("continued", r"(?i)\*{2,}\s*continued\s*\*{2,}|\bcontinued\s+(?:from|to|until)\b|\b(?:was|were|be) continued\b"),
    ("staff_concern", r"(?i)\bstaff\s+concerns?\b|\bstaff\s+(?:is|are|was|were)\s+concerned\b|\bstaff\s+expressed\s+concern\b|\bstaff (?:has|have|had|noted|raised) (?:a )?concerns?\b"),
    ("neighborhood_concern", r"(?i)\bneighborhood\s+(?:concerns?|opposition|opposed)\b|\bresidents?\s+(?:raised|expressed)\s+concern\b|\bresidents?\s+opposition\b|\bcommunity\s+opposition\b|\bneighbou?r(?:s|hood)? (?:concerns?|objected)\b"),
    ("public_opposition", r"(?i)\bpublic\s+(?:opposition|opposed)\b|\bopposition\s+from\s+the\s+public\b|\bmembers\s+of\s+the\s+public\s+opposed\b|\b(?:spoke|letters?) in opposition\b"),
    ("appeal", r"(?i)\bappeal(?:ed|s)?\s+(?:the\s+)?decision\b|\bfiled\s+an\s+appeal\b|\bappeal\s+was\s+filed\b|\bappealed\b"),
    ("additional_information", r"(?i)\badditional\s+information\s+(?:was\s+)?requested\b|\brequested\s+additional\s+information\b|\badditional\s+materials\s+were\s+requested\b|\bfurther\s+information\s+was\s+requested\b"),
    ("amended", r"(?i)\b(?:amended|revised)\s+(?:application|request)\b|\bapplication\s+was\s+amended\b"),
    ("withdrawn", r"(?i)\b(?:application|request)\s+was\s+withdrawn\b|\bwithdrawn\s+application\b|\bapplicant\s+withdrew\b|\b(?:was|were|has) withdrawn\b"),
    ("tabled", r"(?i)\btabled\s+the\s+item\b|\b(?:item|application)\s+was\s+tabled\b|\btabled\b"),
)


def items(packets: DataFrame) -> DataFrame:
    """(doc_id, item, start, end, body) of the blocks of packets, item being the printed number.

    The text before the first heading is a block without a number; a packet without headings is one item 0.
    """
    found = E.item_blocks(packets, "doc_id", "text", ITEM)
    cut = found.join(packets.select("doc_id", "text"), "doc_id").select("doc_id", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("body"))
    cut = cut.select("doc_id", F.regexp_extract("body", r"^(?:ITEM|Item) ([0-9]+)", 1).try_cast("bigint").alias("item"), "start", "end", "body")
    head = F.regexp_extract("text", rf"(?s)^(.*?){ITEM}", 1)
    none, at = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    before = packets.where(F.col("text").rlike(ITEM)).select("doc_id", none.alias("item"), at.alias("start"), F.length(head).cast("bigint").alias("end"), head.alias("body")).where("end > 0")
    whole = packets.where(~F.col("text").rlike(ITEM)).select("doc_id", at.alias("item"), at.alias("start"), F.length("text").cast("bigint").alias("end"), F.col("text").alias("body"))
    return cut.union(before).union(whole)


def own_blocks(scoped: DataFrame) -> DataFrame:
    """(application_number, doc_id, start, body): for each application every block with the printed number of one that names it first.

    An agenda's short entry and the staff report under the same number later both belong to the application.
    A number that only the text before the first heading names has that text as its block.
    """
    number = F.nullif(F.regexp_extract("body", K.APPLICATION_NUMBER, 0), F.lit(""))
    named = scoped.select(number.alias("application_number"), "doc_id", "item").where("application_number is not null").distinct()
    numbered = named.where("item is not null").join(scoped, ["doc_id", "item"])
    stray = named.where("item is null").join(named.where("item is not null"), "application_number", "left_anti").join(scoped.where("item is null").drop("item"), "doc_id")
    cols = ("application_number", "doc_id", "start", "body")
    return numbered.select(*cols).union(stray.select(*cols))


def applications(own: DataFrame) -> DataFrame:
    """One row per application number: applicant, address and description, each as the first of its blocks that states it has it."""
    b = F.col("body")
    bare = F.regexp_replace(b, rf"{ITEM}|{K.APPLICATION_NUMBER}", "\n")  # else a heading on the same line would count as part of the name
    stated = {
        "applicant_name": F.nullif(T.collapse(F.regexp_extract(bare, r"(?i)([A-Z][\w.&' -]{2,80}?) requests?\b", 1)), F.lit("")),
        "project_address": X.address(F.concat(b, F.lit(" "))),
        "application_type": X.application_type(b),
        "description": F.nullif(T.collapse(F.regexp_extract(b, r"(?i)requests? ([^.]+)\.", 1)), F.lit("")),
    }
    got = own.select("application_number", "doc_id", "start", *[c.alias(n) for n, c in stated.items()])
    return got.groupBy("application_number").agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.struct("doc_id", "start"))).alias(n) for n in stated])


def in_order(rows: DataFrame) -> DataFrame:
    """rows with position counted through all packets of their application, so that ties have one order."""
    w = Window.partitionBy("application_number").orderBy("doc_id", "position")
    return rows.withColumn("position", F.dense_rank().over(w)).drop("doc_id")


def signal_events(scoped: DataFrame, own: DataFrame, apps: DataFrame) -> DataFrame:
    """Signal events of each application: kind, confidence, evidence, position; one per kind and date.

    Its own blocks count by what their windows name. Elsewhere in its packets a hit counts only beside the
    applicant's name or the address, and not as continued: the equi-join on the packet comes first, the
    containment is the residual condition. Windows end at the block, so neighbouring items stay apart.
    One alternation of all patterns drops blocks without any hit before anything is exploded.
    """
    any_of = "|".join(f"(?:{p})" for _, p in PATTERNS)
    some = scoped.where(F.col("body").rlike(any_of))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), T.positions(F.col("body"), p).alias("hits")) for k, p in PATTERNS])
    rows = some.select("doc_id", "start", "body", F.explode(each).alias("x")).select("*", "x.kind", F.explode("x.hits").alias("h"))
    around = T.window_around(F.col("body"), F.col("h.start"), F.length("h.hit"), 350, 650)
    near = rows.select("doc_id", "start", "kind", (F.col("start") + F.col("h.start")).alias("position"), T.sentence_at(F.col("body"), F.col("h.start")).alias("sentence"), around.alias("window"))
    near = near.where(~X.is_boilerplate(F.col("window"))).withColumn("window_key", T.match_key(F.col("window")))
    here = own.select("application_number", "doc_id", "start", F.lit(True).alias("own"))
    present = own.select("application_number", "doc_id").distinct().join(apps, "application_number")
    both = near.join(present, "doc_id").join(here, ["application_number", "doc_id", "start"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    beside = lambda c: F.coalesce(F.contains("window_key", F.nullif(T.match_key(F.col(c)), F.lit(""))), F.lit(False))
    both = both.withColumns({"applicant": beside("applicant_name"), "address": beside("project_address")}).where("own or (kind <> 'continued' and (applicant or address))")
    named = F.contains("window", "application_number")
    confidence = F.least(F.lit(0.45) + F.when(named, 0.35).otherwise(0.0) + F.when(F.col("applicant"), 0.15).otherwise(0.0) + F.when(F.col("address"), 0.10).otherwise(0.0), F.lit(0.99))
    elsewhere = F.greatest(confidence, F.when(F.col("address"), 0.80).otherwise(0.75))
    events = both.select("application_number", "doc_id", "kind", "position", F.col("window").alias("evidence"), F.round(F.when(F.col("own"), confidence).otherwise(elsewhere), 2).alias("confidence"), X.event_date(F.col("kind"), F.col("sentence")).alias("event_date"))
    return S.best_events(in_order(events.where("confidence >= 0.55")), ["application_number", "kind", "event_date"], F.struct("confidence", F.length("evidence")), F.col("position"))


def project_dates(scoped: DataFrame, own: DataFrame, reference: str) -> DataFrame:
    """Dates of each application's own blocks and of the text before its packets' first heading, one per day: label, time, score and confidence."""
    before = own.select("application_number", "doc_id").distinct().join(scoped.where("item is null").select("doc_id", F.col("start"), "body"), "doc_id")
    texts = own.union(before.select(*own.columns)).distinct()
    hits = E.hits(texts.withColumnRenamed("start", "block"), "body", D.MENTION)
    sentence, ref = T.sentence_at(F.col("body"), F.col("start")), F.lit(reference).cast("date")
    time = X.near_time(F.col("body"), F.col("start"), F.length("hit"))
    rows = hits.select("application_number", "doc_id", (F.col("block") + F.col("start")).alias("position"), D.parse_date(F.col("hit")).alias("day"), sentence.alias("sentence"), X.local_context(F.col("body"), F.col("start")).alias("context"), time.alias("tm")).where("day is not null")
    rows = in_order(rows).withColumn("future", D.is_future(F.col("day"), ref))
    rows = rows.withColumn("l", X.date_label(F.col("sentence"), F.col("context"), F.col("future")))
    rank = F.try_element_at(S.literal_map(X.LABEL_RANK), F.col("l"))
    rows = rows.withColumn("r", rank)
    score = X.date_score(F.col("sentence"), F.col("context"), F.col("future"), F.col("l"))
    out = S.resolve_groups(rows.withColumn("s", score), ["application_number", "day", "future"], F.col("l"), F.col("r"), F.col("s"), F.col("tm"), F.col("context"), F.col("position"))
    return out


def leads(apps: DataFrame, events: DataFrame, days: DataFrame, reference: str) -> DataFrame:
    """One row per application with score, signals, next date, level and urgency."""
    friction = S.score_by_key(events, ["application_number"], "kind", F.col("confidence"))
    ahead = days.where(F.col("future") & ~F.col("label").isin("deadline", "public_comment_deadline", "appeal_deadline")).groupBy("application_number").agg(F.min(F.struct("day", "label", "time")).alias("n"))
    any_ahead = days.groupBy("application_number").agg(F.max("future").alias("future"))
    base = R.with_defaults(apps, "application_number", {"score": F.lit(0), "signals": F.array().cast("array<string>"), "future": F.lit(False)}, friction, ahead, any_ahead)
    until = D.days_until(F.col("n.day"), F.lit(reference).cast("date"))
    critical = F.arrays_overlap("signals", F.array(*[F.lit(x) for x in ("denied", "withdrawn", "recommended_denial", "appeal")]))
    acts = L.is_actionable(F.col("application_type")) | F.coalesce(F.col("description").rlike(r"(?i)rezone|zone map|general plan|subdivision|variance|conditional use|planned unit"), F.lit(False))
    asks = (F.col("score"), F.col("future"), acts, until, critical)
    return base.select(
        "application_number", "applicant_name", "application_type", "project_address", "description", F.col("score").alias("friction_score"), "signals", F.col("n.day").alias("next_date"), F.col("n.label").alias("next_event"), F.col("n.time").alias("next_time"),
        until.alias("days_until_event"), F.col("future").alias("has_future"), S.queue_score(*asks).alias("priority_score"), S.queue_level(*asks).alias("priority"), S.urgency(until, F.col("future")).alias("urgency"),
    )


def run(packets: DataFrame, reference: str) -> DataFrame:
    """The whole chain; order the result with signals.queue_order where an order is shown."""
    scoped = items(packets)
    own = own_blocks(scoped)
    apps = applications(own)
    return leads(apps, signal_events(scoped, own, apps), project_dates(scoped, own, reference), reference)


def packet_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The chain over all documents; the reference date is given."""
    return run(load(spark, sf, "documents").where("text is not null").select("doc_id", "text"), "2026-01-01")
