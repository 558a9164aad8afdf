"""Readers: text records, delimited tables with loose headers, score tables, panels."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordered
from ..session import cut_lineage


def fasta_records(df: DataFrame, text: str = "value") -> DataFrame:
    """One row per '>'-separated record text: id is the first header token, lines joined; an empty record stays."""
    lines = F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x))
    body = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(1))), "")
    head = F.element_at(lines, 1)
    return df.where(F.trim(text) != "").withColumns({
        "id": F.element_at(F.split(head, r"\s+"), 1), "sequence": F.when(F.size(lines) > 1, body).otherwise(F.lit(""))})


def read_fasta(spark, path) -> DataFrame:
    """FASTA files as (id, sequence); record texts are split by the reader, not collected.

    A record begins where a line does: a '>' inside a header is part of it. Only a file's first record keeps its mark.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    return fasta_records(raw.select(F.regexp_replace("value", r"^\s*>|\s+$", "").alias("value"))).select("id", "sequence")


CHUNK = 1 << 20  # bases that a row of fasta_chunks holds at most


def fasta_chunks(spark, path) -> DataFrame:
    """FASTA files read by byte ranges: runs of bases as (file, block, segment, header, at, bases).

    A task streams the lines of its byte range; a segment is what follows one header in it. Segment 0 continues the
    record that an earlier range opened, and has no header; `at` counts bases from the start of the segment.
    """
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def work(batches):
        here, segment, at = None, 0, 0
        for batch in batches:
            lines = [x.strip() for x in batch.column(0).to_pylist()]
            files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows, low = [], 0
            while low < len(lines):
                if (files[low], blocks[low]) != here:
                    here, segment, at = (files[low], blocks[low]), 0, 0
                    rows.append((*here, 0, None, 0, ""))
                header = None
                if lines[low].startswith(">"):
                    header, segment, at, low = lines[low][1:], segment + 1, 0, low + 1
                    rows.append((*here, segment, header, 0, ""))
                high = low
                while high < len(lines) and not lines[high].startswith(">") and (files[high], blocks[high]) == here:
                    high += 1
                bases = "".join(lines[low:high])
                for i in range(0, len(bases), CHUNK):
                    rows.append((*here, segment, None, at + i, bases[i:i + CHUNK]))
                at, low = at + len(bases), high
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["file", "block", "segment", "header", "at", "bases"])

    return raw.mapInArrow(work, "file string, block bigint, segment bigint, header string, at bigint, bases string")


def _placed(chunks: DataFrame):
    """(chunks with id and start, ids with their lengths): a range takes up its record from the ranges before it."""
    named = chunks.withColumn("id", F.when(F.col("header").isNotNull(), F.coalesce(F.element_at(F.split(F.trim("header"), r"\s+"), 1), F.lit(""))))
    segments = named.groupBy("file", "block", "segment").agg(F.max("id").alias("id"), F.sum(F.length("bases")).alias("n"))
    ranges = segments.groupBy("file", "block").agg(
        F.max_by(F.struct("id", "n"), "segment").alias("tail"), F.max("segment").alias("headers"))
    order = Window.partitionBy("file").orderBy("block")  # a row per byte range
    ranges = ranges.withColumn("record", F.sum((F.col("headers") > 0).cast("int")).over(order))
    inside = Window.partitionBy("file", "record").orderBy("block")
    ranges = ranges.withColumns({"open_id": F.first("tail.id").over(inside), "so_far": F.sum("tail.n").over(inside)})
    carried = ranges.select("file", "block", F.lag("open_id").over(order).alias("open_id"), F.lag("so_far").over(order).alias("open_at"))
    own = segments.where("segment > 0").select("file", "block", "segment", F.col("id").alias("own_id"))
    j = chunks.drop("header").join(carried, ["file", "block"]).join(own, ["file", "block", "segment"], "left")
    first = F.col("segment") == 0
    return j.select(F.when(first, F.col("open_id")).otherwise(F.col("own_id")).alias("id"),
                    (F.col("at") + F.when(first, F.coalesce("open_at", F.lit(0))).otherwise(0)).alias("start"), "bases").where("id IS NOT NULL")


def fasta_lengths(spark, path) -> DataFrame:
    """(id, length) of every record, records without bases included; an id in two records is an error, found here."""
    placed = _placed(fasta_chunks(spark, path))
    return placed.groupBy("id").agg(F.sum(F.length("bases")).alias("length"))


def fasta_pieces(spark, path, piece_len: int = 65_536) -> DataFrame:
    """FASTA files of any size as (chrom, piece, s): pieces of piece_len bases of each record, upper case, the last one shorter.

    No record is ever in one row; a piece that two runs of bases share is put together by one exchange. Ids must be
    those of one record each.
    """
    chunks = cut_lineage(fasta_chunks(spark, path))  # read once for headers and for bases
    twice = chunks.where("header IS NOT NULL").groupBy(F.element_at(F.split(F.trim("header"), r"\s+"), 1).alias("id")).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError("several records are named " + ", ".join(r["id"] for r in twice))
    x = _placed(chunks).where(F.length("bases") > 0)
    last = F.floor((F.col("start") + F.length("bases") - 1) / piece_len)
    x = x.select("id", "start", "bases", F.explode(F.sequence(F.floor(F.col("start") / piece_len), last)).alias("piece"))
    low = F.greatest(F.col("start"), F.col("piece") * piece_len)
    part = F.substr("bases", (low - F.col("start") + 1).cast("int"), ((F.col("piece") + 1) * piece_len - low).cast("int"))
    parts = x.select(F.col("id").alias("chrom"), "piece", low.alias("low"), F.upper(part).alias("part"))
    return parts.groupBy("chrom", "piece").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("p")).select(
        "chrom", "piece", F.array_join(F.col("p.part"), "").alias("s"))


def pasted_records(lines: DataFrame, doc: str, line_no: str, text: str, tile: int = 10_000) -> DataFrame:
    """Records of pasted texts, none lost: a document with any header is FASTA, else one record per line.

    Records are addressed by their index in the document; the id is only a label.
    """
    df = lines.select(doc, line_no, F.trim(text).alias("_x"))
    df = df.withColumns({"_head": F.col("_x").startswith(">"), "_tile": F.floor(F.col(line_no) / tile)}).where("_x <> ''")
    kinds = df.groupBy(doc).agg(F.max("_head").alias("_fasta"), F.min(line_no).alias("_first"))
    df = df.join(kinds, doc)
    opens = ~F.col("_fasta") | F.col("_head") | (F.col(line_no) == F.col("_first"))
    df = ordered.running(df, [doc], "_tile", [line_no], opens.cast("bigint"), "_n", "sum", True)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct(line_no, "_x")))),
                                    lambda p: p["_x"]), "")
    name = F.max(F.when(F.col("_head"), F.trim(F.substr("_x", F.lit(2)))))
    out = df.groupBy(doc, "_n").agg(name.alias("_name"), body.alias("sequence"))
    label = F.when(F.col("_name") != "", F.col("_name"))
    return out.select(doc, (F.col("_n") - 1).alias("index"),
                      F.coalesce(label, F.concat(F.lit("seq_"), F.col("_n").cast("string"))).alias("id"), "sequence",
                      F.when(label.isNotNull(), "fasta_header").otherwise("generated").alias("id_source"))


def _plain(name):
    return re.sub(r"[^a-z0-9]+", "", str(name).lower())


def resolve(columns, aliases, required=()):
    """Logical field to actual header: exact normalised match first, then substring; a missing required field is an error."""
    have = {_plain(c): c for c in columns}
    found = {}
    for field, names in aliases.items():
        wanted = [_plain(n) for n in names]
        exact = [have[w] for w in wanted if w in have]
        loose = [c for w in wanted if w for h, c in have.items() if w in h]
        found[field] = (exact or loose or [None])[0]
    missing = [f for f in required if found.get(f) is None]
    if missing:
        raise ValueError(f"no header stands for {', '.join(missing)} among {', '.join(map(str, columns))}")
    return found


def read_delimited(spark, path) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t" if str(path).endswith((".tsv", ".tab")) else ",").csv(str(path))


def with_fields(df: DataFrame, aliases, required=()) -> DataFrame:
    """Rename a table's loose headers to logical fields; only the schema is looked at."""
    found = {f: c for f, c in resolve(df.columns, aliases, required).items() if c}
    return df.select(*[F.col(f"`{c}`").alias(f) for f, c in found.items()])


SCORE_KEY = ["chromosome", "position", "reference", "alternate"]


def _long_scores(df: DataFrame, order: str) -> DataFrame:
    """A long or wide score table as (key, order, scorer, score) with `fate`: kept, or why a row falls out."""
    if "scorer" in df.columns:
        long = df.select(*SCORE_KEY, order, "scorer", "score")
    else:
        values = [c for c in df.columns if c not in (*SCORE_KEY, order)]
        long = df.unpivot([*SCORE_KEY, order], values, "scorer", "score")
    blank = F.col("score").isNull() | (F.trim(F.col("score").cast("string")) == "")
    long = long.withColumns({"position": F.expr("try_cast(position AS bigint)"), "_blank": blank,
                             "score": F.expr("try_cast(score AS double)")})
    bases = F.coalesce(F.col("reference").rlike("^[ACGTacgt]+$") & F.col("alternate").rlike("^[ACGTacgt]+$"), F.lit(False))
    fate = (F.when(F.col("position").isNull(), "bad_position").when(~bases, "bad_allele").when(F.col("_blank") | F.isnan("score"), "absent")
            .when(F.col("score").isNull(), "bad_score").otherwise("kept"))
    return long.withColumn("fate", fate).drop("_blank")


def score_fates(df: DataFrame, order: str) -> DataFrame:
    """How many rows of a score table were kept, overwritten by a later one, absent or malformed; every row is counted once."""
    long = _long_scores(df, order)
    counts = long.groupBy("fate").agg(F.count("*").alias("n"))
    keys = long.where("fate = 'kept'").groupBy(*SCORE_KEY, "scorer").agg(F.count("*").alias("n")).where("n > 1")
    over = keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("over"))
    j = ordered.attach(counts, over)
    rows = F.when(F.col("fate") == "kept", F.array(F.struct(F.lit("kept").alias("fate"), (F.col("n") - F.col("over")).alias("n")),
                                                   F.struct(F.lit("overwritten").alias("fate"), F.col("over").alias("n")))).otherwise(
        F.array(F.struct(F.col("fate"), F.col("n"))))
    return j.select(F.inline(rows)).where("n > 0")


def score_rows(df: DataFrame, order: str) -> DataFrame:
    """A long or wide score table as (key, scorer, score). Malformed rows fall out, later duplicates win, blanks are absent."""
    kept = _long_scores(df, order).where("fate = 'kept'")
    return kept.groupBy(*SCORE_KEY, "scorer").agg(F.max_by("score", order).alias("score"))


def region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """SNVs of one region of a table partitioned by chromosome and sorted by position, either chromosome spelling."""
    bare = re.sub("(?i)^chr", "", chrom)
    return df.where(F.col("chrom").isin(bare, f"chr{bare}") & F.col("pos").between(start, end)
                    & (F.length("ref") == 1) & (F.length("alt") == 1))


def write_bundle(df: DataFrame, path: str, tile: int = 10_000) -> None:
    """Scores laid out for regions: a folder per chromosome and tile of positions, rows sorted by position.

    Chromosomes lose their prefix, so that either spelling of a region finds them. A hot chromosome is many tiles.
    """
    x = df.withColumns({"chrom": F.regexp_replace("chrom", "(?i)^chr", ""), "tile": F.floor(F.col("pos") / tile)})
    x.repartition("chrom", "tile").sortWithinPartitions("chrom", "tile", "pos").write.mode("overwrite").partitionBy("chrom", "tile").parquet(path)


def read_bundle(spark, path: str, chrom: str, start: int, end: int, tile: int = 10_000) -> DataFrame:
    """SNVs of one region: folders are chosen by chromosome and tile, row groups by the stored positions."""
    bare = re.sub("(?i)^chr", "", chrom)
    df = spark.read.option("mergeSchema", False).parquet(path)
    missing = {"chrom", "tile", "pos", "ref", "alt"} - set(df.columns)
    if missing:
        raise ValueError(f"the bundle has no column {', '.join(sorted(missing))}")
    return df.where((F.col("chrom").cast("string") == bare) & F.col("tile").between(start // tile, end // tile) & F.col("pos").between(start, end)
                    & (F.length("ref") == 1) & (F.length("alt") == 1)).drop("tile").withColumn("chrom", F.concat(F.lit("chr"), F.col("chrom").cast("string")))


def bed(lines: DataFrame, text: str) -> DataFrame:
    f = F.split(F.col(text), "\t")
    return lines.where((F.trim(text) != "") & ~F.col(text).startswith("#") & ~F.col(text).startswith("track")).withColumns({
        "chrom": F.element_at(f, 1), "start": F.element_at(f, 2).cast("bigint"), "end": F.element_at(f, 3).cast("bigint")})


def panel(lines: DataFrame, doc: str, line_no: str, text: str):
    """A '# key: value' block and a tab-separated body: (metadata rows, body rows with their header as map keys)."""
    comment = F.col(text).startswith("#")
    meta = lines.where(comment & F.col(text).contains(":")).select(
        doc, F.trim(F.regexp_extract(text, r"^#+\s*([^:]*):", 1)).alias("key"),
        F.trim(F.regexp_extract(text, r"^#+[^:]*:(.*)$", 1)).alias("value"))
    body = lines.where(~comment & (F.trim(text) != ""))
    head = body.groupBy(doc).agg(F.min(F.struct(line_no, text)).alias("_h"))
    rows = body.join(head, doc).where(F.col(line_no) > F.col(f"_h.{line_no}"))
    cells = F.map_from_arrays(F.split(f"_h.{text}", "\t"), F.split(text, "\t"))
    return meta, rows.select(doc, line_no, cells.alias("cells"))
