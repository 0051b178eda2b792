"""Chat curation: messages, prompts and responses, scores, selection, and training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.corpus import Tokenizer, char_tokenizer, keep_first
from corpusloom.sources.tables import written

ROLES = ("assistant", "system", "user")
MESSAGES = "array<struct<role: string, content: string>>"
IGNORED = -100
QUOTAS = dict(zip((*T.CATEGORIES, T.GENERAL), (0.22, 0.20, 0.20, 0.15, 0.10, 0.05, 0.08)))


def gather_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages) of rows (key, turn, role, text) in the order of their turns."""
    made = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return made.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def messages_from_json(value: Column) -> Column:
    """Messages given as a JSON string; null where it can't be read."""
    return F.from_json(value, MESSAGES)


def parse_messages(messages: Column, known_roles: bool = True) -> Column:
    """Stripped messages without empty ones; curation keeps known roles only. Null if none is left."""
    clean = F.transform(messages, lambda x: F.struct(F.lower(T.strip(F.coalesce(x["role"], F.lit("")))).alias("role"), T.strip(F.coalesce(x["content"], F.lit(""))).alias("content")))
    keep = (lambda x: x["role"].isin(*ROLES) & (x["content"] != "")) if known_roles else (lambda x: (x["role"] != "") & (x["content"] != ""))
    kept = F.filter(clean, keep)
    return F.when(F.size(kept) > 0, kept)


def _last_answer(messages: Column) -> Column:
    """1-based place of the last assistant message; null without one."""
    return F.array_max(F.filter(F.transform(messages, lambda x, i: F.when(x["role"] == "assistant", i + 1)), lambda i: i.isNotNull()))


def standardize(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """Messages up to the last answer; rows without one, or without a user message before it, are dropped."""
    parsed = rows.withColumn(messages, parse_messages(F.col(messages))).withColumn("_last", _last_answer(F.col(messages)))
    cut = parsed.where(F.col("_last").isNotNull()).withColumn(messages, F.slice(messages, F.lit(1), F.col("_last"))).drop("_last")
    before = F.slice(messages, F.lit(1), F.size(messages) - 1)
    return cut.where(F.exists(before, lambda x: x["role"] == "user"))


def standardize_instruction(rows: DataFrame) -> DataFrame:
    """Messages of instruction-style rows: instruction or prompt, input, output or response."""
    get = lambda *names: F.coalesce(*(F.nullif(T.strip(F.col(n)), F.lit("")) for n in names if n in rows.columns), F.lit(""))
    asked, extra, said = get("instruction", "prompt"), get("input"), get("output", "response")
    question = F.concat(asked, F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(F.lit("")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.where((asked != "") & (said != "")).withColumn("messages", F.array(message("user", question), message("assistant", said)))


def prompt_and_response(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """Adds prompt, all contents before the last message joined by line ends, and response, the last one's."""
    before = F.slice(messages, F.lit(1), F.size(messages) - 1)
    return rows.withColumns({"prompt": F.array_join(F.transform(before, lambda x: x["content"]), "\n"), "response": F.element_at(messages, -1)["content"]})


def json_length(messages: Column) -> Column:
    """Length of the example as JSON with a blank after commas and colons, as writers put them by default."""
    return F.length(F.to_json(F.struct(messages.alias("messages")))) + 4 * F.size(messages)


def candidates(rows: DataFrame, *, order: str = "conv_id", source_limit: int | None = None, min_response: int = 80, max_response: int = 3000, max_example: int = 12000) -> DataFrame:
    """Standardised, length-filtered, deduplicated and scored rows.

    ``source_limit`` counts raw rows. Prompts seen before, among rows that passed the length filters, are
    dropped; a check of prompt and response together would never fire after that.
    """
    raw = rows if source_limit is None else rows.orderBy(order).limit(source_limit)
    made = prompt_and_response(standardize(raw))
    fit = made.where(F.length("response").between(min_response, max_response) & (json_length(F.col("messages")) <= max_example))
    first = keep_first(fit, T.dedupe_key(F.col("prompt")), order)
    return first.select(
        order, "messages", "prompt", "response",
        T.round4(T.quality_score(F.col("prompt"), F.col("response"))).alias("score"),
        T.category(F.col("prompt"), F.col("response")).alias("category"),
        F.length("response").alias("response_chars"),
    )


def _by_score(order: str) -> list[Column]:
    return [F.desc("score"), F.desc("response_chars"), F.asc(order)]


def select_longest(rows: DataFrame, target: int, order: str = "conv_id") -> DataFrame:
    return rows.orderBy(F.desc("response_chars"), F.desc("score"), F.asc(order)).limit(target)


def _selected(rows: DataFrame, group: Column, target: int, order: str, most: int) -> DataFrame:
    """First rows by (group, score). Beyond ``most`` of a category only the fill pass can take a row, and
    no more than ``target`` of a category are ever taken, so ranks past that needn't be ordered."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("category").orderBy(*_by_score(order)))).where(F.col("_rank") <= max(target, most, 1))
    return ranked.withColumn("_group", group).orderBy("_group", *_by_score(order)).limit(max(1, target)).drop("_rank", "_group")


def select_quality(rows: DataFrame, target: int, cap: int | None = None, order: str = "conv_id") -> DataFrame:
    """Best scores with at most ``cap`` of a category first, then by score alone; a target of 0 takes one row."""
    cap = max(200, target // 3) if cap is None else cap
    return _selected(rows, F.when(F.col("_rank") <= cap, 0).otherwise(1), target, order, cap)


def quotas(target: int) -> dict[str, int]:
    return {c: max(1, round(target * share)) for c, share in QUOTAS.items()}


def select_mixed(rows: DataFrame, target: int, order: str = "conv_id") -> DataFrame:
    """Each category's quota in the order of the categories, then by score alone."""
    group = F.lit(len(QUOTAS))
    for i, (name, quota) in enumerate(quotas(target).items()):
        group = F.when((F.col("category") == name) & (F.col("_rank") <= quota), i).otherwise(group)
    return _selected(rows, group, target, order, max(quotas(target).values()))


def summarize(rows: DataFrame) -> DataFrame:
    """One row: size, mean score and length (0 without rows), and counts by category in order of name."""
    by = rows.groupBy("category").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("response_chars").alias("chars"))
    size = F.coalesce(F.sum("n"), F.lit(0))
    mean = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / F.greatest(F.lit(1), size)
    return by.agg(size.alias("size"), F.round(mean("score"), 4).alias("mean_score"), F.round(mean("chars"), 1).alias("mean_response_chars"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"))


# Rendering and encoding of training samples

_HEAD = {"system": "### System:\n", "user": "### Instruction:\n", "assistant": "### Response:\n"}


def _section(role: str, content: Column) -> Column:
    return F.concat(F.lit(_HEAD[role]), content, F.lit("\n\n"))


def render_messages(messages: Column, system: str | None = None) -> Column:
    """struct(prompt, response); null without an answer. Unknown roles are left out; no user message is needed."""
    parsed = parse_messages(messages, known_roles=False)
    last = _last_answer(parsed)

    def part(x: Column) -> Column:
        out = F.lit("")
        for role in _HEAD:
            out = F.when(x["role"] == role, _section(role, x["content"])).otherwise(out)
        return out

    body = F.array_join(F.transform(F.slice(parsed, F.lit(1), last - 1), part), "")
    prompt = F.concat(F.lit(f"{_HEAD['system']}{system.strip()}\n\n" if system and system.strip() else ""), body, F.lit(_HEAD["assistant"]))
    return F.when(last.isNotNull(), F.struct(prompt.alias("prompt"), F.element_at(parsed, last)["content"].alias("response")))


def render_instruction(instruction: Column, extra: Column, output: Column, system: str | None = None) -> Column:
    """struct(prompt, response); null without instruction or output."""
    clean = lambda c: T.strip(F.coalesce(c, F.lit("")))
    asked, more, said = clean(instruction), clean(extra), clean(output)
    prompt = F.concat(
        F.lit(f"{_HEAD['system']}{system.strip()}\n\n" if system and system.strip() else ""),
        _section("user", asked),
        F.when(more != "", F.concat(F.lit("### Input:\n"), more, F.lit("\n\n"))).otherwise(F.lit("")),
        F.lit(_HEAD["assistant"]),
    )
    return F.when((asked != "") & (said != ""), F.struct(prompt.alias("prompt"), said.alias("response")))


def render_sample(rows: DataFrame, system: str | None = None) -> DataFrame:
    """Adds sample: the messages' rendering where there is one, else the instruction's."""
    col = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    arms = [render_messages(F.col("messages"), system)] if "messages" in rows.columns else []
    arms.append(render_instruction(F.coalesce(F.nullif(T.strip(col("instruction")), F.lit("")), col("prompt")), col("input"), F.coalesce(F.nullif(T.strip(col("output")), F.lit("")), col("response")), system))
    return rows.withColumn("sample", F.coalesce(*arms))


def encode_sample(rows: DataFrame, block: int, *, sample: str = "sample", tokenizer: Tokenizer = char_tokenizer, end_id: int | None = 0, pad_id: int | None = None, train_on_prompt: bool = False) -> DataFrame:
    """Adds input_ids, attention_mask and labels of ``block`` places; drops rows without a supervised label left."""
    prompt, answer = tokenizer(F.col(sample)["prompt"]), tokenizer(F.col(sample)["response"])
    end = F.array(F.lit(end_id)) if end_id is not None else F.expr("CAST(array() AS array<int>)")
    pad = pad_id if pad_id is not None else end_id if end_id is not None else 0
    made = rows.where(F.col(sample).isNotNull()).withColumns({"_p": prompt, "_r": F.concat(answer, end)})
    ids = F.concat("_p", "_r")
    labels = ids if train_on_prompt else F.concat(F.array_repeat(F.lit(IGNORED), F.size("_p")), "_r")
    cut = made.withColumns({"_i": F.slice(ids, 1, block), "_l": F.slice(labels, 1, block)}).where(F.exists("_l", lambda x: x != IGNORED))
    fill = lambda c, with_: F.concat(c, F.array_repeat(F.lit(with_), F.lit(block) - F.size("_i")))
    full = cut.withColumns({"input_ids": fill(F.col("_i"), pad), "attention_mask": fill(F.array_repeat(F.lit(1), F.size("_i")), 0), "labels": fill(F.col("_l"), IGNORED)})
    return full.drop("_p", "_r", "_i", "_l")


def sample_dataset(rows: DataFrame, block: int, *, order: str = "conv_id", system: str | None = None, max_chars: int | None = None, max_examples: int | None = None, **encoding) -> DataFrame:
    """Encoded samples of rows with messages: the size filter on the raw row, encoding, and the first ``max_examples`` encoded; 0 keeps one."""
    fit = rows if max_chars is None else rows.where(json_length(F.col("messages")) <= max_chars)
    made = encode_sample(render_sample(fit, system), block, **encoding)
    return made if max_examples is None else made.orderBy(order).limit(max(1, max_examples))


def train_and_eval(train: DataFrame, evaluation: DataFrame, target: int, eval_size: int, strategy: str = "quality", order: str = "conv_id") -> DataFrame:
    """Rows of both sets with their ``split``; an error where a set comes out smaller than asked for.

    Candidates are worked out once: what is chosen is written, then counted and read from there. Pass no more
    columns than are needed. The evaluation set is always chosen by quality. ``leaked`` marks its rows that are in the training set too.
    """
    choose = {"longest": select_longest, "quality": select_quality, "mixed": select_mixed}[strategy]
    if train is evaluation:  # one table, which both choices read
        train = evaluation = written(train, "candidates")
    chosen = {"train": choose(train, target, order=order), "eval": select_quality(evaluation, eval_size, max(80, eval_size // 3), order)}
    chosen = {split: written(rows, f"chosen-{split}") for split, rows in chosen.items()}  # no more rows than asked for, or 1
    for (split, rows), wanted in zip(chosen.items(), (target, eval_size)):
        if (n := rows.count()) < wanted:
            raise RuntimeError(f"{split}: {n} rows are left of {wanted} asked for")
    ids = chosen["train"].select(order, F.lit(True).alias("_in"))
    held = chosen["eval"].join(F.broadcast(ids) if target <= 1_000_000 else ids, order, "left")
    marked = held.withColumn("leaked", F.coalesce("_in", F.lit(False))).drop("_in").withColumn("split", F.lit("eval"))
    return chosen["train"].withColumns({"leaked": F.lit(False), "split": F.lit("train")}).unionByName(marked)


def supervised_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED))
