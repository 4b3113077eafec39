"""Readers of raw submissions, golden or predicted section files, and run results; writers of the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"
#: Fixed value: what counts as a bold heading of an item.
BOLD_ITEM = r"(?iU)font-weight:\s*(?:bold|700)[^>]*>\s*item\s*\d"
MAIN = r"(?is)<TYPE>\s*10-K(/A)?\s*\n"


def main_document(content: Column) -> Column:
    """The text of the first 10-K or 10-K/A block, up to the end of the block; the whole content without one."""
    blocks = F.filter(F.regexp_extract_all(content, F.lit(BLOCK), F.lit(1)), lambda b: b.rlike(MAIN))
    body = F.regexp_extract(F.get(blocks, F.lit(0)), r"(?is)<TEXT>(.*)\z", 1)
    return F.when(body != "", body).otherwise(content)


def text_start(content: Column, main: Column) -> Column:
    """The offset of ``main`` (the content's main document) in the submission; 0 for the fallback."""
    return F.when(main == content, 0).otherwise(F.instr(content, main) - 1)


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.txt$", 1).alias("accession"), F.col("value").alias("content"))
    docs = raw.select("accession", "content", main_document(F.col("content")).alias("html"))
    return docs.withColumn("text_start", text_start(F.col("content"), F.col("html")))


#: Submissions are read block by block: a record ends where a block ends.
BLOCK_END = "</DOCUMENT>"


def _placed(raw: DataFrame) -> DataFrame:
    meta = F.col("_metadata")
    return raw.select(meta.file_path.alias("path"), meta.file_size.alias("bytes"), meta.file_block_start.alias("split"), "value")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.monotonically_increasing_id())


def records(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, bytes (of the file), split and n (which order a file's records), value: the records of all ``*.txt`` files in the folders.

    Large files are read by several tasks.
    """
    return _numbered(_placed(spark.read.option("lineSep", BLOCK_END).option("pathGlobFilter", "*.txt").text(folders)))


def bundle(texts: DataFrame, folder: str) -> None:
    """Many submissions (accession, content) in few files: small ones cost a file and a folder each otherwise.

    A line is a block, so lines end where blocks end and no mark has to be told from the text.  Before the block stand the accession, the submission's
    size in bytes and the block's number, by tabs; an accession has none.  Like a file of no bytes, an empty or null text has no record.
    """
    cut = texts.select("accession", F.octet_length("content").alias("bytes"), F.split("content", BLOCK_END, -1).alias("l"))
    # behind the last block's end nothing is left, which is no record in a file either
    filled = F.when(F.element_at("l", -1) == "", F.slice("l", 1, F.size("l") - 1)).otherwise(F.col("l"))
    kept = cut.select("accession", "bytes", F.posexplode(filled).alias("k", "piece"))
    kept.select(F.concat_ws("\t", "accession", "bytes", "k", "piece").alias("value")).write.option("lineSep", BLOCK_END).text(folder)


def bundled(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The records of all submissions in the bundles of the folders, as ``records`` gives them; ``path`` is the accession."""
    raw = spark.read.option("lineSep", BLOCK_END).option("pathGlobFilter", "*.txt").text(folders).select(F.split("value", "\t", 4).alias("x"))
    at = lambda k: F.get("x", F.lit(k))
    return raw.select(at(0).alias("path"), at(1).cast("long").alias("bytes"), at(2).cast("long").alias("split"), F.lit(0).cast("long").alias("n"), at(3).alias("value"))


def main_documents(rows: DataFrame) -> DataFrame:
    """path, html, text_start: each file's main document and its offset in code points, from ``records`` or ``bundled``.

    Equal to ``main_document`` of whole files, but a task holds a block and not a submission: what is gathered by
    file are its main block and the sizes of the others.  Only a file without one, whose main document is the whole file, is put together again.
    """
    tail = F.lit(BLOCK_END)
    first = lambda text: F.get(F.filter(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)), lambda b: b.rlike(MAIN)), F.lit(0))
    may = F.col("value").rlike(MAIN)
    # the last record of a file may lack its end, so both readings go on
    cut = rows.select("path", "bytes", "split", "n", F.length("value").alias("chars"), F.octet_length("value").alias("octets"), F.when(may, first(F.concat("value", tail))).alias("closed"), F.when(may, first(F.col("value"))).alias("open"), F.when(may, F.col("value")).alias("value"))
    files = cut.groupBy("path").agg(
        F.max("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("split", "n", "chars", "octets"))).alias("parts"),
        F.expr("min_by(struct(split, n, closed, open, value), struct(split, n)) FILTER (WHERE closed IS NOT NULL)").alias("main"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda t, p: t + p.octets + len(BLOCK_END))
    last = F.element_at("parts", -1)
    whole = (F.col("main.split") < last.split) | (F.col("main.n") < last.n) | (size == F.col("bytes"))
    body = F.regexp_extract(F.when(whole, F.col("main.closed")).otherwise(F.col("main.open")), r"(?is)<TEXT>(.*)\z", 1)
    before = F.aggregate(F.filter("parts", lambda p: (p.split < F.col("main.split")) | ((p.split == F.col("main.split")) & (p.n < F.col("main.n")))), F.lit(0).cast("long"), lambda t, p: t + p.chars + len(BLOCK_END))
    found = files.select("path", F.when(body != "", body).alias("html"), before.alias("before"), F.col("main.value").alias("value"), (size == F.col("bytes")).alias("ended"))
    main = found.filter("html is not null").select("path", "html", (F.col("before") + F.instr("value", F.col("html")) - 1).alias("text_start"))
    bare = found.filter("html is null").select("path", "ended")
    texts = rows.join(bare, "path").groupBy("path").agg(F.first("ended").alias("ended"), F.array_sort(F.collect_list(F.struct("split", "n", "value"))).alias("l"))
    joined = F.concat(F.array_join(F.transform("l", lambda x: x.value), BLOCK_END), F.when(F.col("ended"), BLOCK_END).otherwise(""))
    return main.unionByName(texts.select("path", joined.alias("html"), F.lit(0).cast("long").alias("text_start")))


def _accession(path: Column, suffix: str) -> Column:
    return F.regexp_extract(path, rf"([^/]+)\.{suffix}$", 1)


def stream_main_documents(spark: SparkSession, folder: str, out: str, checkpoint: str, files: int | None = None):
    """Main documents of submissions as they arrive, as Parquet (accession, path, html, text_start); a stop is resumed at the first file not done.

    A batch has whole files and writes one folder, whole, so a batch that is run again replaces what it wrote.
    """
    src = spark.readStream.option("lineSep", BLOCK_END).option("pathGlobFilter", "*.txt")
    src = (src.option("maxFilesPerTrigger", files) if files else src).text(folder)
    rows = _placed(src)

    def batch(df: DataFrame, number: int) -> None:
        main_documents(_numbered(df)).select(_accession(F.col("path"), "txt").alias("accession"), "path", "html", "text_start").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listed(spark: SparkSession, folders: list[str], suffix: str = "txt") -> DataFrame:
    """accession, folder (its place in the list), path, size of all files; none is opened and missing folders are empty."""
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    out = spark.createDataFrame([], "accession string, folder int, path string, size long")
    for k, name in enumerate(folders):
        where = jvm.Path(name)
        if where.getFileSystem(conf).exists(where):
            found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(name)
            out = out.unionByName(found.select(_accession(F.col("path"), suffix).alias("accession"), F.lit(k).alias("folder"), "path", F.col("length").alias("size")))
    return out


def find_filings(spark: SparkSession, sources: list[str], golden: list[str], limit: int | None = None) -> DataFrame:
    """accession, gt_set, source_path, gt_path, html_size, gt_item_count, difficulty: filings with a source and a golden file that has items.

    The first folder that has a source counts; empty and malformed golden files are passed over; sets in their order, then accessions, up to ``limit``.
    """
    places = listed(spark, golden, "json").select("accession", F.col("folder").alias("gt_set"), F.col("path").alias("gt_path"))
    items = None
    for k, name in enumerate(golden):
        if places.filter(F.col("gt_set") == k).limit(1).count():
            more = sections(spark, name).withColumn("gt_set", F.lit(k))
            items = more if items is None else items.unionByName(more)
    if items is None:
        return spark.createDataFrame([], "accession string, gt_set int, source_path string, gt_path string, html_size int, gt_item_count long, difficulty string")
    chosen = discover(listed(spark, sources), items, limit).join(places, ["accession", "gt_set"])
    kept = [f for f in sources if listed(spark, [f]).limit(1).count()]
    uri = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the two readers write a local path differently
    html = main_documents(records(spark, kept)).select(uri("path").alias("at"), F.length("html").alias("html_size"), difficulty(F.col("html")).alias("difficulty"))
    return chosen.withColumn("at", uri("path")).join(html, "at").select("accession", "gt_set", F.col("path").alias("source_path"), "gt_path", "html_size", "gt_item_count", "difficulty")


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """accession, item, html from ``{accession#item: html}`` files; ``malformed`` marks files that don't parse."""
    raw = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.json$", 1).alias("accession"), F.from_json("value", "map<string,string>").alias("m"))
    return raw.select("accession", F.col("m").isNull().alias("malformed"), F.explode_outer("m").alias("key", "html")).withColumn("item", F.when(F.instr("key", "#") > 0, F.expr("substring(key, instr(key, '#') + 1)")).otherwise(F.col("key")))


def discover(sources: DataFrame, golden: DataFrame, limit: int | None = None) -> DataFrame:
    """Filings with a golden file: ``sources`` (accession, folder, path), the first folder wins; empty files are skipped.

    Where ``golden`` has the number of its set (``gt_set``) a limit takes the sets in order, then accessions.
    """
    first = sources.withColumn("r", F.row_number().over(Window.partitionBy("accession").orderBy("folder", "path"))).filter("r = 1").drop("r")
    keys = ["gt_set", "accession"] if "gt_set" in golden.columns else ["accession"]
    full = golden.filter("not malformed and key is not null").groupBy(*keys).agg(F.count("*").alias("gt_item_count"))
    out = first.join(full, "accession")
    return out.orderBy(*keys).limit(limit) if limit else out


def difficulty(html: Column) -> Column:
    """By the number of bold "item N" headings in the first third."""
    n = F.regexp_count(F.substring(html, 1, F.floor(F.length(html) / 3).cast("int")), F.lit(BOLD_ITEM))
    return F.when(n >= 10, "easy").when(n >= 3, "medium").otherwise("hard")


def unfinished(filings: DataFrame, results: DataFrame) -> DataFrame:
    """Filings without a row in earlier results."""
    return filings.join(results.select("accession").distinct(), "accession", "left_anti")


def as_json(slices: DataFrame) -> DataFrame:
    """One ``{accession#item: html}`` object for each filing."""
    entry = F.struct(F.concat_ws("#", "accession", "item").alias("k"), F.col("html").alias("v"))
    return slices.groupBy("accession").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))
