"""Uses of language-model libraries in source code: imports with call sites, long inline prompts, agents, tools of servers.

files: repo_id, path, text. A file is looked into only where one of the short literals occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import line_of

#: Fixed values: (label, modules as they are imported, calls that use them). A short table of our own.
SDKS = (
    ("Anthropic SDK", r"anthropic|@anthropic-ai/sdk", r"messages\.(?:create|stream)"),
    ("OpenAI SDK", r"openai", r"(?:chat\.completions|responses|embeddings)\.create"),
    ("Google Gen AI", r"google\.generativeai|@google/genai", r"generate_?[cC]ontent"),
    ("LangChain", r"langchain[\w.]*|@langchain/[\w-]+", r"\.invoke\(|ChatPromptTemplate"),
    ("LlamaIndex", r"llama_index[\w.]*|llamaindex", r"as_query_engine|VectorStoreIndex"),
    ("Transformers", r"transformers", r"from_pretrained|pipeline\("),
    ("MCP SDK", r"mcp[\w.]*|@modelcontextprotocol/sdk[\w/.-]*|fastmcp", r"@\w+\.tool|\.tool\(|registerTool\("),
)
_CODE = r"\.(py|js|mjs|ts|tsx|jsx|go|java|kt|rs|cs|rb)$"
_ASIDE = r"(?i)(^|/)(tests?|__tests__|fixtures?|node_modules|vendor)/|\.(test|spec)\.[jt]sx?$|(^|/)test_[^/]+\.py$"


def _imports(modules: str) -> str:
    return rf"(?m)^\s*(?:import|from)\s+(?:{modules})\b|(?:from|require\()\s*[\"'](?:{modules})[\"']"


def _code(files: DataFrame) -> DataFrame:
    return files.filter(F.rlike("path", F.lit(_CODE)) & F.col("text").isNotNull())


def sdk_usage(files: DataFrame) -> DataFrame:
    """repo_id, sdk, files, call_sites, first_path: products' code before tests."""
    hits = F.array(*[F.when(F.rlike("text", F.lit(_imports(m))), F.struct(F.lit(label).alias("sdk"), F.regexp_count("text", F.lit(calls)).alias("calls"))) for label, m, calls in SDKS])
    rows = _code(files).select("repo_id", "path", F.explode(hits).alias("h")).filter("h is not null")
    aside = F.rlike("path", F.lit(_ASIDE))
    return rows.groupBy("repo_id", F.col("h.sdk").alias("sdk")).agg(F.count("*").alias("files"), F.sum("h.calls").cast("long").alias("call_sites"), F.min_by("path", F.struct(aside, "path")).alias("first_path"))


def inline_prompts(files: DataFrame, least: int = 180, spaces: int = 20) -> DataFrame:
    """repo_id, path, line, name, prompt: long strings of prose that are assigned to a name with prompt, instructions or system in it."""
    pattern = r"(?is)\b(\w*(?:prompt|instructions|system_message)\w*)\s*(?::\s*str\s*)?=\s*(?:[frb]{0,2}(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')|`([^`]*)`)"
    rows = _code(files).filter(F.rlike("text", F.lit("(?i)prompt|instructions|system_message")))
    found = rows.select("repo_id", "path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("hit"))
    body = F.trim(F.concat(*[F.regexp_extract("hit", pattern, i) for i in (2, 3, 4)]))
    out = found.select("repo_id", "path", line_of(F.col("text"), F.col("hit")).alias("line"), F.regexp_extract("hit", pattern, 1).alias("name"), body.alias("prompt"))
    return out.filter((F.length("prompt") >= least) & (F.regexp_count("prompt", F.lit(" ")) >= spaces))


def server_tools(files: DataFrame) -> DataFrame:
    """repo_id, path, tool: functions under a tool decorator, and tools registered by name."""
    decorated = r"(?m)^\s*@\w+\.tool\b[^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(\w+)"
    registered = r"\.(?:tool|registerTool)\(\s*[\"'`]([\w.-]+)[\"'`]"
    rows = _code(files).filter(F.contains("text", F.lit("tool")) | F.contains("text", F.lit("Tool")))
    tools = F.concat(F.regexp_extract_all("text", F.lit(decorated), F.lit(1)), F.regexp_extract_all("text", F.lit(registered), F.lit(1)))
    return rows.select("repo_id", "path", F.explode(F.array_distinct(tools)).alias("tool"))


def model_ids(files: DataFrame) -> DataFrame:
    """repo_id, model, files: model names between quotes, in lower case."""
    pattern = r"[\"'`]((?:gpt-[0-9o][\w.-]*|o[134](?:-[\w-]+)?|claude-[\w.-]+|gemini-[0-9][\w.-]*|llama-?[0-9][\w.-]*|mistral-[\w.-]+|text-embedding-[\w-]+))[\"'`]"
    rows = _code(files).select("repo_id", "path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.lower))).alias("model"))
    return rows.groupBy("repo_id", "model").agg(F.count("*").alias("files"))


def servers(configs: DataFrame) -> DataFrame:
    """repo_id, path, server, launches: servers of configuration files, with the package that a launcher runs.

    A server given by a URL launches nothing; flags of the launcher are skipped; a version behind the name is dropped.
    """
    entry = "map<string,struct<command:string,args:array<string>,url:string>>"
    j = F.from_json("text", f"mcpServers {entry}, servers {entry}")
    rows = configs.filter(F.rlike("path", F.lit(r"(^|/)\.?mcp\.json$"))).select("repo_id", "path", F.explode(F.coalesce(j["mcpServers"], j["servers"])).alias("server", "s"))
    args = F.filter(F.coalesce("s.args", F.array().cast("array<string>")), lambda a: ~F.startswith(a, F.lit("-")) & ~a.isin("run", "exec", "dlx", "tool"))
    launcher = F.regexp_extract("s.command", r"([^/]+)$", 1).isin("npx", "uvx", "bunx", "pnpm", "yarn", "pipx", "uv")
    package = F.when(F.col("s.url").isNull() & launcher, F.regexp_replace(F.get(args, F.lit(0)), r"(?<=.)(@|==)[^/]*$", ""))
    return rows.select("repo_id", "path", "server", package.alias("launches"))
