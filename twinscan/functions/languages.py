"""Language detection by file name, suffix and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.functions.text import literal_map, strip

# Suffixes and whole file names of each language.
LANGUAGE_FILES = {
    "ada": [".ada", ".ads", ".adb"],
    "asm": [".asm", ".s", ".S"],
    "bash": [".sh", ".bash", ".zsh", ".fish"],
    "c": [".c", ".h"],
    "csharp": [".cs", ".csx"],
    "cpp": [".cpp", ".cxx", ".cc", ".c++", ".hpp", ".hxx", ".hh", ".h++"],
    "cmake": [".cmake", "CMakeLists.txt"],
    "css": [".css", ".scss", ".sass", ".less"],
    "dart": [".dart"],
    "dockerfile": ["Dockerfile", ".dockerfile"],
    "fortran": [".f", ".f90", ".f95", ".f03", ".f08", ".for", ".ftn", ".fpp"],
    "go": [".go"],
    "gomod": [".mod", ".sum"],
    "graphql": [".graphql", ".gql"],
    "groovy": [".groovy", ".gradle"],
    "haskell": [".hs", ".lhs"],
    "html": [".html", ".htm", ".xhtml"],
    "java": [".java", ".jsp"],
    "javascript": [".js", ".mjs", ".jsx"],
    "json": [".json", ".jsonc", ".json5"],
    "julia": [".jl"],
    "kotlin": [".kt", ".kts"],
    "lua": [".lua"],
    "make": ["Makefile", "makefile", ".mk", ".make"],
    "markdown": [".md", ".markdown", ".mdown", ".mkd", ".mdx"],
    "matlab": [".m", ".mlx"],
    "ocaml": [".ml", ".mli"],
    "pascal": [".pas", ".pp", ".inc", ".dpr", ".dpk", ".dfm", ".fmx"],
    "perl": [".pl", ".pm", ".perl"],
    "php": [".php", ".php3", ".php4", ".php5", ".phtml"],
    "python": [".py", ".pyi", ".pyw", ".pyx", ".pxd", ".pxi"],
    "r": [".r", ".R", ".rmd", ".Rmd"],
    "ruby": [".rb", ".rbw", ".rake", ".gemspec", "Rakefile", "Gemfile"],
    "rust": [".rs"],
    "scala": [".scala", ".sc"],
    "solidity": [".sol"],
    "sql": [".sql", ".mysql", ".pgsql", ".plsql"],
    "svelte": [".svelte"],
    "swift": [".swift"],
    "toml": [".toml"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "vue": [".vue"],
    "xml": [".xml", ".xsl", ".xslt", ".xsd", ".wsdl", ".svg"],
    "yaml": [".yaml", ".yml"],
}
# Lower-cased names looked up only when a file has no suffix.
BARE_NAMES = {
    "dockerfile": "dockerfile",
    "makefile": "make",
    "rakefile": "ruby",
    "gemfile": "ruby",
    "cmakelists.txt": "cmake",
}
# Languages without functions.
NO_FUNCTIONS = [
    "xml", "html", "css", "json", "yaml", "toml", "markdown", "sql", "cmake", "make", "dockerfile", "gomod",
]
DEFAULT_LANGUAGE = "python"

FILE_LANGUAGE = {name: language for language, names in LANGUAGE_FILES.items() for name in names}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last dotted ending of the file name, lower-cased; '' for none, dot files and trailing dots."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def detect_language(path: Column, content: Column | None = None) -> Column:
    name, ending = file_name(path), suffix(path)
    table = literal_map(FILE_LANGUAGE)
    found = [
        F.try_element_at(table, name),
        F.try_element_at(table, ending),
        F.when(ending == "", F.try_element_at(literal_map(BARE_NAMES), F.lower(name))),
    ]
    if content is not None:
        found.append(_language_of_content(content))
    return F.coalesce(*found, F.lit(DEFAULT_LANGUAGE))


def _language_of_content(content: Column) -> Column:
    body = strip(F.lower(content))
    first = F.lower(F.element_at(F.split(content, "\n"), 1))
    wrapped = (body.startswith("{") & body.endswith("}")) | (body.startswith("[") & body.endswith("]"))
    return (
        F.when(body.startswith("#!") & first.contains("python"), "python")
        .when(body.startswith("#!") & first.contains("sh"), "bash")
        .when(body.startswith("#!") & first.contains("node"), "javascript")
        .when(
            body.startswith("<?xml") | (body.contains("<") & body.contains(">")),
            F.when(body.contains("<!doctype html") | body.contains("<html"), "html").otherwise("xml"),
        )
        .when(wrapped, "json")
    )


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILE_LANGUAGE.items()), "file_key string, language string")


def supported_languages(spark: SparkSession) -> DataFrame:
    return language_table(spark).select("language").distinct()


def supported_extensions(spark: SparkSession) -> DataFrame:
    return language_table(spark).select("file_key")


def is_supported(path: Column) -> Column:
    """True when the lower-cased suffix is a known key; whole names such as Makefile do not count."""
    return F.try_element_at(literal_map(FILE_LANGUAGE), suffix(path)).isNotNull()
