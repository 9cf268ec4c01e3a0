"""Discovery of documents and source files.

The rules are on tables of (path, length), path relative to the root, so they hold
for any listing: a folder's, an archive's, an index's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which files are read decides what a graph holds.
TEXT = ["md", "txt", "markdown", "rst", "org", "adoc", "log", "jsonl", "csv"]
SKIPPED = ["node_modules", ".git", "dist", "build", "__pycache__", ".vs", "obj", "bin", "vendor", ".terraform", "processed"]
LANGUAGES = {
    "cs": "csharp", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "yaml": "yaml", "yml": "yaml", "json": "json",
    "bicep": "bicep", "ps1": "powershell", "psm1": "powershell", "psd1": "powershell",
}
CODE_FOLDERS = ["obj", "bin", ".vs", "node_modules", "__pycache__", ".terraform", ".git", "vendor", "dist", ".vscode"]
CODE_FILES = [r"\.Designer\.cs$", r"AssemblyInfo\.cs$", r"\.g\.cs$", r"\.pyc$", r"\.min\.js$", r"\.min\.css$", r"(^|/)package-lock\.json$", r"(^|/)yarn\.lock$"]
MOST_BYTES = 500_000
#: Walked, but without a parser.
UNPARSED = ["javascript", "powershell", "bicep"]


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _extension(path: Column) -> Column:
    """What follows the last dot of the file's name, in lower case; nothing where the name begins with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def document_paths(files: DataFrame) -> DataFrame:
    """The rows of files (path, length) that are text to take in: by extension, not empty, below 500,000 bytes, not hidden nor in a hidden or skipped folder. A null path or length is left out."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda x: x.startswith(".") & (x != ".md"))
    return files.filter((F.col("length") > 0) & (F.col("length") < MOST_BYTES) & ~hidden & ~F.exists(_folders(F.col("path")), lambda x: x.isin(SKIPPED)) & _extension(F.col("path")).isin(TEXT))


def source_paths(files: DataFrame, extensions: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """The rows of files (path) that are source code, with their language. Dockerfiles go by name or ending.

    extensions: those to take, without dots, of LANGUAGES; excludes: patterns that a
    path must not match, in place of the folders and files left out otherwise."""
    name = F.element_at(F.split("path", "/"), -1)
    known = {e: kind for e, kind in LANGUAGES.items() if extensions is None or e in extensions}
    language = F.lit(None).cast("string") if not known else F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[_extension(F.col("path"))]
    docker = name.isin("Dockerfile", "dockerfile") | F.lower(name).endswith(".dockerfile")
    if excludes is None:
        out = F.exists(_folders(F.col("path")), lambda x: x.isin(CODE_FOLDERS)) | F.col("path").rlike("|".join(CODE_FILES))
    else:
        out = F.col("path").rlike("|".join(f"(?:{p})" for p in excludes)) if excludes else F.lit(False)
    return files.filter(~out).withColumn("language", F.when(docker, "dockerfile").otherwise(language)).filter("language is not null")


def _below(spark: SparkSession, root: str) -> DataFrame:
    """All files below root: path relative to it, length, content (read only where it is selected)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return rows.select(F.substring(plain, len(top) + 2, 1 << 20).alias("path"), "length", "content")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), text of the documents below root."""
    return document_paths(_below(spark, root)).select("path", F.decode("content", "UTF-8").alias("text"))


def read_sources(spark: SparkSession, root: str, extensions: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """file_path (relative to root), language, text of the source files below root."""
    return source_paths(_below(spark, root), extensions, excludes).select(F.col("path").alias("file_path"), "language", F.decode("content", "UTF-8").alias("text"))
