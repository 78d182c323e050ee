"""Files in: corpora, search results, QA outputs, prompt tables, rollouts, runs. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutmill.functions.text import clean_text, strip
from scoutmill.functions.urls import url_hash
from scoutmill.operators.ordering import number_rows
from scoutmill.operators.sampling import sample_rows, seeded

CORRUPT = "_corrupt_record"
CORPUS = f"id string, text string, metadata struct<title:string,url:string>, {CORRUPT} string"
SEARCH = f"query string, position int, title string, link string, url string, snippet string, content string, {CORRUPT} string"
QA_FILE = "url string, url_hash string, revision_url string, qa_pairs array<struct<question:string,answer:string>>"
NEWS = "title string, published_date string, description string, content string, link string"
EVAL_RUN = (
    "metadata map<string,string>, records array<struct<question:string,answer:string,prediction:string,rollout_idx:int,error:string,"
    "judge:struct<status:string,correct:string>,turn_times:array<struct<turn:int,llm_time:double,tool_time:double,action:string>>>>"
)
ROLLOUT = (
    "input string, output string, gts string, score double, step int, correct boolean, method string, pred_ans string, raw_response string, "
    "input_tokens int, output_tokens int, total_tokens int, total_turns int, data_source string"
)


def _permissive(spark: SparkSession, schema: str, path: str | list[str], **options) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.json(path)


def file_stem(path: Column | None = None) -> Column:
    """File name without folder and extension."""
    path = F.input_file_name() if path is None else path
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def read_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Nested corpus lines as (id, title, url, text); rows without text and unreadable lines go.

    ``url`` defaults to the id. A missing id becomes ``doc_<n>``, n being the
    place of the line among the id-less ones in a stable order of their content.
    """
    raw = _permissive(spark, CORPUS, path).filter(F.col(CORRUPT).isNull())
    rows = raw.filter(strip(F.coalesce("text", F.lit(""))) != "").withColumn("_file", F.input_file_name())
    named = rows.filter(F.col("id").isNotNull())
    unnamed = number_rows(rows.filter(F.col("id").isNull()), ["_file", "text", "metadata.title", "metadata.url"], "_n").withColumn(
        "id", F.concat(F.lit("doc_"), F.col("_n").cast("string")))
    both = named.unionByName(unnamed.drop("_n"))
    return both.select(
        clean_text("id").alias("id"), clean_text("metadata.title").alias("title"),
        clean_text(F.coalesce("metadata.url", "id")).alias("url"), clean_text("text").alias("text"))


def corpus_errors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines read, malformed, and without text."""
    raw = _permissive(spark, CORPUS, path)
    bad = F.col(CORRUPT).isNotNull()
    return raw.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_malformed"),
                   F.count_if(~bad & (strip(F.coalesce("text", F.lit(""))) == "")).alias("n_empty"))


def read_search_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Flat search-result lines with a stable ``line_no``; unreadable lines go."""
    raw = _permissive(spark, SEARCH, path).filter(F.col(CORRUPT).isNull()).drop(CORRUPT).withColumn("_file", F.input_file_name())
    return number_rows(raw, ["_file", "query", "position", "link", "url", "title", "snippet", "content"], "line_no").drop("_file")


def read_text_with_fallback(spark: SparkSession, path: str, encodings: Sequence[str] = ("utf-8", "gb18030", "latin-1")) -> DataFrame:
    """Whole files as text: gunzipped when they start with the gzip mark, first encoding that fits, else replacement characters."""
    tried = list(encodings)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for batch in batches:
            rows = []
            for path_, content in zip(batch["path"], batch["content"]):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                for name in tried:
                    try:
                        rows.append((path_, data.decode(name), name))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    rows.append((path_, data.decode("utf-8", errors="replace"), "utf-8:replace"))
            yield pd.DataFrame(rows, columns=["path", "text", "encoding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, text string, encoding string")


def read_lines_with_fallback(spark: SparkSession, path: str, encodings: Sequence[str] = ("utf-8", "gb18030", "latin-1")) -> DataFrame:
    """Lines of files as (path, line, encoding): each file in the first encoding that fits all its lines, else UTF-8 with replacement characters.

    A large file is read in byte ranges that end at line ends, by as many tasks
    as it has ranges, and a ``.gz`` file as a stream; no file is held whole. The
    ranges count the lines that each encoding fails on, and the sums choose.
    Encodings must write a line end as the byte 10 and no other sign with that
    byte (not UTF-16). Empty lines stay; a carriage return before a line end goes.
    """
    tried = list(encodings)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("bytes"))

    def fits(data: bytes, name: str) -> bool:
        try:
            data.decode(name)
        except UnicodeDecodeError:
            return False
        return True

    def failures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odd = batch[~batch["bytes"].map(bytes.isascii)]
            found = pd.DataFrame({f"f{i}": (~odd["bytes"].map(lambda b, n=n: fits(b, n)).astype(bool)).astype("int64") for i, n in enumerate(tried)})
            found["path"] = odd["path"]
            yield found.groupby("path", as_index=False).sum()[["path", *(f"f{i}" for i in range(len(tried)))]]

    counts = lines.mapInPandas(failures, ", ".join(["path string", *(f"f{i} long" for i in range(len(tried)))])).groupBy("path").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(tried))])
    first = F
    for i, name in enumerate(tried):
        first = first.when(F.col(f"f{i}") == 0, name)
    chosen = counts.select("path", first.otherwise("utf-8:replace").alias("encoding"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [b.decode(n.split(":")[0], errors="replace" if ":" in n else "strict").removesuffix("\r") for b, n in zip(batch["bytes"], batch["encoding"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "line": text, "encoding": batch["encoding"]})

    # A file of ASCII alone fits whatever comes first.
    named = lines.join(chosen, "path", "left").withColumn("encoding", F.coalesce("encoding", F.lit(tried[0])))
    return named.mapInPandas(decode, "path string, line string, encoding string")


def read_qa_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """QA pairs of one-document-per-file outputs; unreadable files and pairs without both fields go."""
    files = _permissive(spark, f"{QA_FILE}, {CORRUPT} string", path, multiLine="true").withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    pairs = files.filter(F.col(CORRUPT).isNull()).select("url", "revision_url", "source_file", F.posexplode("qa_pairs").alias("pair_no", "p"))
    rows = pairs.select("url", "revision_url", "source_file", "pair_no", "p.question", "p.answer")
    return rows.filter(F.col("question").isNotNull() & F.col("answer").isNotNull())


def read_articles(spark: SparkSession, path: str | list[str], start: int = 0, end: int | None = None, order: str = "id") -> DataFrame:
    """Articles (id, url, title, text) with a global index in key order, optionally a half-open index range."""
    rows = number_rows(spark.read.parquet(*([path] if isinstance(path, str) else path)).select("id", "url", "title", "text"), [order], "_n")
    rows = rows.withColumn("index", F.col("_n") - 1).drop("_n").filter(F.col("index") >= start)
    return rows if end is None else rows.filter(F.col("index") < end)


def read_news(spark: SparkSession, path: str | list[str], limit: int | None = None, seed: int = 42) -> DataFrame:
    """News rows as (index, url, markdown); only the five columns used are read; a limit samples."""
    cols = [f.split()[0] for f in NEWS.split(", ")]
    raw = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(*cols)
    filled = raw.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    if limit is not None:
        filled = sample_rows(filled, limit, cols, seed)
    rows = number_rows(filled, seeded(cols, seed), "_n").withColumn("index", F.col("_n") - 1)
    markdown = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("Published: "), "published_date"), "description", "content")
    url = F.when(F.col("link") != "", F.col("link")).otherwise(F.concat(F.lit("bbc:"), F.col("index").cast("string")))
    return rows.select("index", url.alias("url"), url_hash(url).alias("url_hash"), markdown.alias("markdown"))


def read_prompt_tables(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prompt parquets as one frame; ``data_source`` is the file's name; missing files are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        return hp.getFileSystem(conf).exists(hp)

    frames = [spark.read.parquet(p).withColumn("data_source", F.lit(p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet"))) for p in paths if there(p)]
    if not frames:
        raise FileNotFoundError("none of the prompt tables exists")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_rollouts(spark: SparkSession, path: str, schema: str = ROLLOUT) -> DataFrame:
    """Rollout lines of all files below a folder; the step is the file's number (or its ``step=`` folder's), other names are ignored."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,txt}").option(
        "columnNameOfCorruptRecord", CORRUPT).json(path)
    foldered = F.regexp_extract(F.input_file_name(), r"/step=(\d+)/", 1).try_cast("int")
    stemmed = raw.withColumn("step", F.coalesce(file_stem().try_cast("int"), foldered))
    return stemmed.filter(F.col("step").isNotNull() & F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_rollout_extras(spark: SparkSession, path: str) -> DataFrame:
    """Rollout lines as maps, for fields that vary from run to run."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    rows = lines.select(file_stem().try_cast("int").alias("step"), F.from_json("value", "map<string,string>").alias("fields"))
    return rows.filter(F.col("step").isNotNull() & F.col("fields").isNotNull())


def read_url_list(spark: SparkSession, path: str, is_json: bool = True) -> DataFrame:
    """URLs out of a JSON list or object (urls, links, data, results) of strings or objects, or of a text file."""
    if not is_json:
        return spark.read.text(path).select(strip("value").alias("url")).filter(F.col("url") != "")
    whole = spark.read.option("wholetext", "true").text(path).select("value")
    items = "array<string>"
    keyed = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), items) for k in ("urls", "links", "data", "results")])
    is_list = F.col("value").rlike(r"^\s*\[")
    rows = whole.select(is_list.alias("plain"), F.explode(F.when(is_list, F.from_json("value", items)).otherwise(keyed)).alias("item"))
    is_object = F.col("item").rlike(r"^\s*\{")
    inner = F.coalesce(F.nullif(F.get_json_object("item", "$.url"), F.lit("")), F.get_json_object("item", "$.link"))
    # A bare list holds objects only; a keyed list may hold strings too.
    url = F.when(is_object, inner).when(~F.col("plain"), F.col("item"))
    return rows.select(url.alias("url")).filter(strip(F.coalesce("url", F.lit(""))) != "")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from a JSON list or lines: ``question``, else the first user message after ``User:``."""
    schema = "question string, answer string, messages array<struct<role:string,content:string>>"
    # Lists span lines and line files do not, so the two are read by extension.
    raw = spark.read.schema(schema).option("multiLine", str(not path.endswith(".jsonl")).lower()).json(path)
    return raw.select(question_of(F.col("question"), F.col("messages")).alias("question"), "answer").filter(F.col("question").isNotNull())


def question_of(question: Column, messages: Column) -> Column:
    """Question text of a record."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    texts = F.transform(users, lambda m: strip(F.regexp_replace(F.coalesce(m["content"], F.lit("")), r"(?s)^.*?User:", "")))
    first = F.get(F.filter(texts, lambda t: t != ""), F.lit(0))
    return F.coalesce(F.nullif(strip(question), F.lit("")), first)


def read_eval_run(spark: SparkSession, path: str) -> DataFrame:
    """Records of evaluation run files, one row each."""
    files = spark.read.schema(EVAL_RUN).option("multiLine", "true").json(path)
    return files.select(F.input_file_name().alias("source_file"), F.posexplode("records").alias("record_no", "r")).select("source_file", "record_no", "r.*")


def pending_files(listing: DataFrame, ledger: DataFrame, key: str = "file") -> DataFrame:
    """Corpus shards not in the ledger, by shard number; files without one come last (9999)."""
    number = F.coalesce(F.regexp_extract(key, r"-(\d{4})\.json\.gz$", 1).try_cast("int"), F.lit(9999))
    return listing.join(ledger.select(key), key, "left_anti").withColumn("shard", number).orderBy("shard", key)
