"""The match export: what a viewer needs for one match, as JSON lines or as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.prefix import Running, running
from touchline.session import cut_lineage

SECTIONS = ("match", "period", "goal", "card", "evidence", "fact")


def export_lines(
    matches: DataFrame, periods: DataFrame, goals: DataFrame, cards: DataFrame, sentences: DataFrame, evidence: DataFrame, facts: DataFrame
) -> DataFrame:
    """Lines (match_id, section, place, json) of every match document.

    A document is a sequence of lines rather than one value, so a match with very many
    goals or evidence rows is still written by many tasks. Only pre-match metadata and
    what the replay has shown is included, never the recorded final score.
    """
    clock = F.struct("period", "minute", "second").alias("clock")
    said = sentences.select("match_id", "event_id", F.col("kind").alias("said_kind"), "sentence")
    fact_kinds = ("lineup", "formation_change", "substitution")

    def lines(df: DataFrame, section: str, place, *fields) -> DataFrame:
        return df.select(
            "match_id", F.lit(section).alias("section"), place.cast("bigint").alias("place"), F.to_json(F.struct(*fields)).alias("json")
        )

    card_rows = cards.join(
        said.where(~F.col("said_kind").isin(*fact_kinds)).withColumnRenamed("said_kind", "kind"), ["match_id", "event_id", "kind"]
    )
    fact_rows = facts.join(
        said.where(F.col("said_kind").isin(*fact_kinds)).withColumnRenamed("said_kind", "kind"), ["match_id", "event_id", "kind"]
    )
    score = F.struct(F.col("home_score").alias("home"), F.col("away_score").alias("away")).alias("score")
    at = lambda side: F.struct(F.col(f"{side}_x").alias("x"), F.col(f"{side}_y").alias("y")).alias(side)
    parts = [
        lines(matches, "match", F.lit(0), F.col("match_id").alias("id"), F.col("competition_id").alias("competition"),
              F.col("season_id").alias("season"), F.date_format("match_date", "yyyy-MM-dd").alias("date"),
              F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away")),
        lines(periods, "period", F.col("period"), "period", "start_minute", "start_second", "end_minute", "end_second"),
        lines(goals, "goal", F.col("sequence"), "event_id", clock, "team_id", "own_goal", "penalty", score),
        lines(card_rows, "card", F.col("sequence") * 2 + F.col("kind_rank"), F.col("card_id").alias("id"), "kind", "experimental",
              "team_id", clock, F.col("event_id").alias("trigger_event_id"), score, "sentence"),
        lines(evidence, "evidence", F.col("sequence"), "card_id", "event_id", "role", clock, "team_id", "action", at("start"), at("end")),
        lines(fact_rows, "fact", F.col("sequence"), clock, "kind", "team_id", "sentence", "event_id"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def write_match_export(lines: DataFrame, matches: DataFrame, folder: str) -> None:
    """``documents/match_id=…`` in document order, and an index of pre-match metadata only."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    ordered = lines.withColumn("_rank", rank).repartitionByRange("match_id", "_rank", "place", "json").sortWithinPartitions("match_id", "_rank", "place", "json")
    ordered.select("match_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("match_id").text(f"{folder}/documents")
    matches.select("match_id", "competition_id", "season_id", "match_date", "home_team_id", "away_team_id").write.mode("overwrite").json(f"{folder}/index")


# --- one document per match ---------------------------------------------------------------

SCHEMA_VERSION = 1
CHUNK_BYTES = 4_000_000
HEAD, PERIODS, GOALS, CARDS, FACTS, TAIL = range(6)
ORDER = ("section", "main", "part", "place", "tie")


def _quoted(text: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.struct(text.alias("s")))
    return F.substring(one, F.lit(6), F.length(one) - 6)


def _piece(rows: DataFrame, section: int, main, part: int, place, tie, text: Column, item: bool) -> DataFrame:
    """A piece of a document with its place in the order; an ``item`` of a list is preceded by a comma unless it is the first."""
    whole = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("bigint")
    return rows.select(
        "match_id", F.lit(section).alias("section"), whole(main).alias("main"), F.lit(part).alias("part"), whole(place).alias("place"),
        whole(tie).alias("tie"), text.alias("text"), F.lit(item).alias("item"),
    )


def document_pieces(
    matches: DataFrame, periods: DataFrame, goals: DataFrame, cards: DataFrame, sentences: DataFrame, evidence: DataFrame, lines: DataFrame, facts: DataFrame,
    attribution: str, source: str,
) -> DataFrame:
    """The pieces of each match's document, every one short: braces, fields, items.

    ``matches`` has names of competition, season and both teams; ``lines`` the evidence lines of cards (card_id, section, position, text).
    A document holds pre-match metadata and what the replay has shown, never the recorded final score.
    """
    clock = F.struct("period", "minute", "second").alias("clock")
    said = sentences.select("match_id", "team_id", "event_id", F.col("kind"), "sentence")
    own = ["match_id", "team_id", "event_id", "kind"]
    score = F.struct(F.col("home_score").alias("home"), F.col("away_score").alias("away")).alias("score")
    team = lambda side: F.struct(F.col(f"{side}_team_id").alias("id"), F.col(f"{side}_team_name").alias("name")).alias(side)
    about = F.struct(
        F.col("match_id").alias("id"), F.col("competition_name").alias("competition"), F.col("season_name").alias("season"),
        F.date_format("match_date", "yyyy-MM-dd").alias("date"), team("home"), team("away"),
    )
    head = F.concat(F.lit(f'{{"schema_version":{SCHEMA_VERSION},"attribution":'), _quoted(F.lit(attribution)), F.lit(',"match":'), F.to_json(about), F.lit(',"periods":['))
    ends = [F.struct("period", F.col(f"{e}_minute").alias("minute"), F.col(f"{e}_second").alias("second")).alias(e) for e in ("start", "end")]
    goal = F.struct("event_id", clock, "team_id", "own_goal", "penalty", score)
    # Read by five kinds of pieces; a small row per card.
    told = cut_lineage(cards.join(said, own))
    # Evidence belongs to its card: the place of the card leads, then the part of the card, then the place in the list.
    card_at = F.col("sequence") * 2 + F.col("kind_rank")
    fields = F.to_json(
        F.struct(F.col("card_id").alias("id"), "kind", "experimental", "team_id", clock, F.col("event_id").alias("trigger_event_id"), score, "sentence")
    )
    opened = F.concat(F.substring(fields, F.lit(1), F.length(fields) - 1), F.lit(',"evidence_lines":['))
    where = told.select("match_id", "card_id", card_at.alias("_card"), F.col("event_id").alias("_trigger"))
    at = lambda side: F.when(F.col(f"{side}_x").isNotNull(), F.struct(F.col(f"{side}_x").alias("x"), F.col(f"{side}_y").alias("y"))).alias(side)
    shown = F.to_json(F.struct("event_id", "role", clock, "team_id", "action", at("start"), at("end")), {"ignoreNullFields": "false"})
    seen = evidence.join(where, ["match_id", "card_id"])
    spoken = lines.join(where, ["match_id", "card_id"])
    fact = F.to_json(F.struct(clock, "kind", "team_id", "sentence", "event_id"))
    shots_first = F.when(F.col("role") == "shot", 0).otherwise(1)
    pieces = [
        _piece(matches, HEAD, 0, 0, 0, 0, head, False),
        _piece(periods, PERIODS, 0, 0, F.col("period"), 0, F.to_json(F.struct("period", *ends)), True),
        _piece(matches, GOALS, -1, 0, -1, 0, F.lit('],"goals":['), False),
        _piece(goals, GOALS, F.col("sequence"), 0, 0, 0, F.to_json(goal), True),
        _piece(matches, CARDS, -1, 0, -1, 0, F.lit('],"cards":['), False),
        _piece(told, CARDS, card_at, 0, 0, F.col("event_id"), opened, True),
        _piece(spoken, CARDS, F.col("_card"), 1, F.col("section") * 2**40 + F.col("position"), F.col("_trigger"), _quoted(F.trim("text")), True),
        _piece(told, CARDS, card_at, 2, 0, F.col("event_id"), F.lit('],"evidence":['), False),
        _piece(seen, CARDS, F.col("_card"), 3, shots_first * F.lit(2**40) + F.col("sequence"), F.col("event_id"), shown, True),
        _piece(told, CARDS, card_at, 4, 0, F.col("event_id"), F.concat(F.lit('],"sources":['), _quoted(F.lit(source)), F.lit("]}")), False),
        _piece(matches, FACTS, -1, 0, -1, 0, F.lit('],"facts":['), False),
        _piece(facts.join(said, own), FACTS, F.col("sequence"), 0, F.col("team_id"), F.col("event_id"), fact, True),
        _piece(matches, TAIL, 0, 0, 0, 0, F.lit("]}"), False),
    ]
    out = pieces[0]
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out


def document_chunks(pieces: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``match_id``, ``chunk`` (from 0), ``text``: the document of a match is its chunks one after the other.

    A prefix sum of lengths over the pieces in order says which chunk a piece is in; it is carried over blocks of the order, so one
    very long document is laid out and put together by many tasks, each holding about ``chunk_bytes``. Chunks end between pieces.
    """
    # Cards and their evidence are 256 places of the stream to a block.
    block = F.col("section").cast("bigint") * 2**36 + F.floor((F.col("main") + 1) / 512)
    # A card opens a list of its own, so items are counted within card and part; other lists within their section.
    listed = F.when((F.col("section") == CARDS) & F.col("part").isin(1, 3), F.col("main")).otherwise(F.lit(-1))
    rows = cut_lineage(pieces).withColumns({"_list": listed, "_size": (F.octet_length("text") + 1).cast("bigint")})
    laid = running(
        rows, ["match_id"], list(ORDER), block,
        [Running("_before", "sum", F.col("_size"), exclusive=True), Running("_items", "sum", F.col("item").cast("bigint"), ("section", "part", "_list"), exclusive=True)],
    )
    text = F.when(F.col("item") & (F.col("_items") > 0), F.concat(F.lit(","), F.col("text"))).otherwise(F.col("text"))
    placed = laid.select("match_id", F.floor(F.col("_before") / chunk_bytes).alias("chunk"), F.struct(*ORDER, text.alias("text")).alias("_p"))
    joined = placed.groupBy("match_id", "chunk").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return joined.select("match_id", "chunk", F.array_join("_p.text", "").alias("text"))


def write_documents(chunks: DataFrame, matches: DataFrame, folder: str) -> None:
    """``documents/match_id=…``: the files of a match in name order are its document, one line a chunk (a line break between pieces is
    blank space in JSON). ``index``: pre-match metadata only."""
    ordered = chunks.repartitionByRange("match_id", "chunk").sortWithinPartitions("match_id", "chunk")
    ordered.select("match_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("match_id").text(f"{folder}/documents")
    about = ["match_id", "competition_name", "season_name", "match_date", "home_team_name", "away_team_name"]
    matches.select(*about).write.mode("overwrite").json(f"{folder}/index")
