"""HTML trees, ZIP archives, chunk and question files as DataFrames."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.functions.text import text_sha256
from corvane.functions.url import source_url


def safe_path(path: Column) -> Column:
    """True for a relative path without empty, ``.`` or ``..`` parts, drive letters or backslashes."""
    return ~(path.rlike(r"(^|/)\.{0,2}(/|$)") | path.rlike(r"^/|\\|^[A-Za-z]:"))


def html_tree(spark: SparkSession, root: str, base_url: str, prefixes: tuple[str, ...] = ("",), per_prefix: int | None = None) -> DataFrame:
    """Source documents of every ``*.html`` below a root whose path starts with a prefix.

    The prefix filter is on the path column, so contents of other files are not read. ``per_prefix`` keeps the first
    files of each prefix in path order, for trial runs.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(root)
    path = F.regexp_extract("path", r"\Q" + root.split(":", 1)[-1].lstrip("/") + r"\E/(.*)$", 1)
    rows = files.select(path.alias("logical_path"), "content").withColumn("prefix", F.get(F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.startswith("logical_path", p)), F.lit(0)))
    rows = rows.where(F.col("prefix").isNotNull() & safe_path(F.col("logical_path")))
    if per_prefix is not None:
        first = rows.select("prefix", "logical_path").withColumn("n", F.row_number().over(Window.partitionBy("prefix").orderBy("logical_path"))).where(F.col("n") <= per_prefix)
        rows = rows.join(first.select("logical_path"), "logical_path", "left_semi")
    # A file that is not UTF-8 has a null content: a failure row when it is parsed, not the end of the job.
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return as_documents(rows.select("logical_path", text.alias("content")), base_url, "local_html")


def as_documents(rows: DataFrame, base_url: str, kind: str) -> DataFrame:
    """logical_path and content with the other fields of a source document."""
    url = source_url(base_url, F.col("logical_path"))
    return rows.select(url.alias("source_url"), url.alias("canonical_url"), "content", text_sha256(F.col("content")).alias("content_sha256"), F.lit(kind).alias("source_kind"), "logical_path", F.substring_index("logical_path", "/", 1).alias("category"))


def missing_prefixes(documents: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Prefixes that no document has."""
    wanted = documents.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    return wanted.join(documents.select("logical_path"), F.startswith("logical_path", F.col("prefix")), "left_anti")


MEMBERS = "array<struct<path:string,size:bigint,packed:bigint,kind:string,mode:int>>"
_MEMBER = pa.list_(pa.struct([("path", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("kind", pa.string()), ("mode", pa.int32())]))


def zip_members(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """``archives`` with an array ``members`` of each binary archive; unreadable ones have null."""

    @arrow_udf(MEMBERS)
    def members(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for raw in batch.to_pylist():
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        out.append([{"path": i.filename.rstrip("/") if i.is_dir() else i.filename, "size": i.file_size, "packed": i.compress_size, "kind": _kind(i), "mode": i.external_attr >> 16} for i in z.infolist()])
                except zipfile.BadZipFile:
                    out.append(None)
            yield pa.array(out, _MEMBER)

    return archives.withColumn("members", members(F.col(content_col)))


def _kind(info: zipfile.ZipInfo) -> str:
    form = info.external_attr >> 16 & 0o170000
    if info.is_dir():
        return "directory" if form in (0, 0o040000) else "special"
    return "file" if form in (0, 0o100000) else "symlink" if form == 0o120000 else "special"


#: Names that Windows reserves.
DEVICES = "CON PRN AUX NUL".split() + [f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)]


def portable_identity(path: Column) -> Column:
    """Paths with equal identities collide on some file system: NFC, case-folded."""

    @arrow_udf("string")
    def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([p and unicodedata.normalize("NFC", p).casefold() for p in batch.to_pylist()], pa.string())

    return fold(path)


def member_problems(members: DataFrame, max_members: int = 10_000, max_member_bytes: int = 1 << 26, max_total_bytes: int = 1 << 30) -> DataFrame:
    """path, problem of every member of a table (path, size, kind) that must not be extracted; null path: the archive."""
    reserved = F.exists(F.split("path", "/"), lambda part: F.upper(F.regexp_extract(part, r"^([^.]*)", 1)).isin(DEVICES))
    devices = members.where(reserved).select("path", F.lit("reserved_name").alias("problem"))
    unsafe = members.where(~safe_path(F.col("path"))).select("path", F.lit("unsafe_path").alias("problem"))
    special = members.where(~F.col("kind").isin("file", "directory")).select("path", F.lit("special_entry").alias("problem"))
    large = members.where(F.col("size") > max_member_bytes).select("path", F.lit("member_too_large").alias("problem"))
    folded = members.withColumn("identity", portable_identity(F.col("path")))
    same = folded.groupBy("identity").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1").select("path", F.lit("collision").alias("problem"))
    parts = F.split("identity", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = folded.where(F.col("identity").contains("/")).select("path", F.explode(ups).alias("up"))
    files = folded.where("kind = 'file'").select(F.col("identity").alias("up"))
    inside = above.join(files, "up", "left_semi").select("path", F.lit("file_directory_collision").alias("problem"))
    totals = members.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    whole = totals.select(F.explode(F.array_compact(F.array(F.when(F.col("n") > max_members, F.lit("too_many_members")), F.when(F.col("bytes") > max_total_bytes, F.lit("archive_too_large"))))).alias("problem")).select(F.lit(None).cast("string").alias("path"), "problem")
    out = devices
    for part in (unsafe, special, large, same, inside, whole):
        out = out.unionByName(part)
    return out


def archive_problems(infos: list[zipfile.ZipInfo], max_members: int, max_member_bytes: int, max_total_bytes: int) -> list[tuple[str | None, str]]:
    """(path, problem) of the members of one archive by the rules of ``member_problems``, before any is read."""
    found: list[tuple[str | None, str]] = []
    if len(infos) > max_members:
        found.append((None, "too_many_members"))
    if sum(i.file_size for i in infos) > max_total_bytes:
        found.append((None, "archive_too_large"))
    names = [i.filename.rstrip("/") if i.is_dir() else i.filename for i in infos]
    folded = [unicodedata.normalize("NFC", n).casefold() for n in names]
    plain = {f for f, i in zip(folded, infos, strict=True) if _kind(i) == "file"}
    times = Counter(folded)
    for info, name, fold in zip(infos, names, folded, strict=True):
        parts = name.split("/")
        rules = {
            "reserved_name": any(p.split(".")[0].upper() in DEVICES for p in parts),
            "unsafe_path": any(p in ("", ".", "..") for p in parts) or "\\" in name or name[1:2] == ":",
            "special_entry": _kind(info) not in ("file", "directory"),
            "member_too_large": info.file_size > max_member_bytes,
            "collision": times[fold] > 1,
            "file_directory_collision": any(fold[:k] in plain for k, c in enumerate(fold) if c == "/"),
        }
        found += [(name, problem) for problem, wrong in rules.items() if wrong]
    return found


def zip_pages(archives: DataFrame, base_url: str, sha256: str | None = None, content_col: str = "content", on_problem: str = "raise", max_members: int = 10_000, max_member_bytes: int = 1 << 26, max_total_bytes: int = 1 << 30) -> DataFrame:
    """HTML members of pinned archives as source documents; an archive of another SHA-256 raises.

    An archive with a member that must not be extracted raises before anything of it is read; with ``on_problem="skip"`` only
    such members are left out, but limits on the whole archive still raise. A member is read up to its limit, whatever size
    it claims.
    """
    if on_problem not in ("raise", "skip"):
        raise ValueError("on_problem must be raise or skip")
    content = F.col(content_col)
    if sha256 is not None:
        content = F.when(F.sha2(content, 256) == sha256, content).otherwise(F.raise_error(F.lit("archive SHA-256 differs")).cast("binary"))
    def read(raw: bytes) -> Iterator[dict[str, str]]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            problems = archive_problems(z.infolist(), max_members, max_member_bytes, max_total_bytes)
            refused = problems if on_problem == "raise" else [p for p in problems if p[0] is None]
            if refused:
                raise ValueError("archive refused: " + ", ".join(f"{problem} {path or ''}".strip() for path, problem in refused[:5]))
            left_out = {path for path, _ in problems}
            total = 0
            for info in z.infolist():
                if _kind(info) == "file" and info.filename.lower().endswith(".html") and info.filename not in left_out:
                    with z.open(info) as member:
                        body = member.read(max_member_bytes + 1)
                    total += len(body)
                    if len(body) > max_member_bytes or total > max_total_bytes:
                        raise ValueError(f"archive refused: {info.filename} is larger than it claims")
                    yield {"path": info.filename, "html": body.decode("utf-8", "replace")}

    # Pages are handed on one by one, so a task holds one archive and one page of it.
    rows = archives.select(content.alias("content")).mapInArrow(_unpacked(read), "path string, html string")
    rows = rows.select(F.col("path").alias("logical_path"), F.col("html").alias("content"))
    return as_documents(rows, base_url, "zip_html")


def _unpacked(read):
    """Rows (path, html) of archives, a page at a time."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                if raw.is_valid:
                    for page in read(raw.as_py()):
                        yield pa.RecordBatch.from_pylist([page], schema=pa.schema([("path", pa.string()), ("html", pa.string())]))

    return unpack


def jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """JSON lines with a schema; blank lines are skipped and a bad line becomes a row with ``problem`` set."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", schema).alias("row"), F.try_parse_json("value").alias("json"))
    problem = F.when(F.col("json").isNull(), F.lit("invalid_json"))
    for name in required:
        problem = problem.when(F.col(f"row.{name}").isNull(), F.lit(f"missing_or_wrong_type:{name}"))
    return rows.select("row.*", problem.otherwise(F.lit(None).cast("string")).alias("problem"))


CHUNK_LINES = "text string, page_title string, section_title string, source_url string, category string, chunk_index int, start_index int"
QUESTION_LINES = "id string, question string, query_type string, topic string, expected_url_keywords array<string>"
QUERY_TYPES = ("exact_identifier", "conceptual", "operational")


def question_problems(questions: DataFrame, development: DataFrame | None = None) -> DataFrame:
    """id, problem of a question table: blank text, no keyword, repeated id, unknown type, overlap with development ids."""
    blank = questions.where(F.coalesce(F.trim("question"), F.lit("")) == "").select("id", F.lit("blank_question").alias("problem"))
    bare = questions.where(F.coalesce(F.size("expected_url_keywords"), F.lit(0)) < 1).select("id", F.lit("no_keywords").alias("problem"))
    twice = questions.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("problem"))
    kind = questions.where(F.col("query_type").isNotNull() & ~F.col("query_type").isin(*QUERY_TYPES)).select("id", F.lit("unknown_query_type").alias("problem"))
    out = blank.unionByName(bare).unionByName(twice).unionByName(kind)
    if development is not None:
        out = out.unionByName(questions.join(development.select("id"), "id", "left_semi").select("id", F.lit("overlaps_development").alias("problem")))
    return out
