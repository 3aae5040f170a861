"""Expressions over arrays of messages: struct(role, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinmill.functions.text import stripped, tag_label


def of_role(messages: Column, *roles: str) -> Column:
    return F.filter(messages, lambda m: m["role"].isin(*roles))


def transcript(messages: Column, names: dict[str, str], sep: str = "\n") -> Column:
    """One line per message of a named role: ``Name : content``."""
    label = lambda m: F.coalesce(*(F.when(m["role"] == r, F.lit(n)) for r, n in names.items()))
    return F.array_join(F.transform(of_role(messages, *names), lambda m: F.concat(label(m), F.lit(" : "), F.coalesce(m["content"], F.lit("")))), sep)


def chatml(messages: Column, learned: str | None = None) -> Column:
    """Messages in chat markup; those of the ``learned`` role between span marks."""
    head = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"))
    body = lambda m: F.concat(F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>"))
    if learned is None:
        each = lambda m: F.concat(head(m), body(m), F.lit("\n"))
    else:
        each = lambda m: F.concat(head(m), F.when(m["role"] == learned, F.concat(F.lit("{% generation %}"), body(m), F.lit("{% endgeneration %}"))).otherwise(body(m)), F.lit("\n"))
    return F.array_join(F.transform(messages, each), "")


def alternates(messages: Column) -> Column:
    """Whether no two neighbours have one role."""
    pairs = F.sequence(F.lit(1), F.size(messages) - 1)
    same = F.exists(pairs, lambda i: F.element_at(messages, i.cast("int"))["role"] == F.element_at(messages, (i + 1).cast("int"))["role"])
    return F.when(F.size(messages) < 2, True).otherwise(~same)


def structure_problems(messages: Column, least: int = 3) -> Column:
    """What is wrong with a training conversation; empty if nothing is."""
    roles = F.transform(messages, lambda m: m["role"])
    body = F.filter(messages, lambda m: m["role"] != "system")
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.size(messages), F.lit(0)) < least, "trop_court"),
            F.when(~F.array_contains(roles, "user"), "sans_user"),
            F.when(~F.array_contains(roles, "assistant"), "sans_assistant"),
            F.when(~alternates(body), "alternance"),
            F.when(F.exists(messages, lambda m: stripped(F.coalesce(m["content"], F.lit(""))) == ""), "message_vide"),
        )
    )


def as_training(system: str, dialogue: Column, roles: dict[str, str], conclusion: Column) -> Column:
    """A system message, the non-blank turns with mapped roles, and the conclusion."""
    msg = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    kept = F.filter(dialogue, lambda m: stripped(F.coalesce(m["content"], F.lit(""))) != "")
    role = lambda m: F.coalesce(*(F.when(m["role"] == a, F.lit(b)) for a, b in roles.items()), m["role"])
    return F.concat(F.array(msg(F.lit("system"), F.lit(system))), F.transform(kept, lambda m: msg(role(m), stripped(m["content"]))), F.array(msg(F.lit("assistant"), conclusion)))


def last(messages: Column, n: int) -> Column:
    return F.when(F.size(messages) <= n, messages).otherwise(F.slice(messages, -n, n))


def all_but_last(messages: Column) -> Column:
    return F.when(F.size(messages) > 0, F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)


def last_of(messages: Column, role: str = "assistant") -> Column:
    """The content of the last message of a role, else of the last message."""
    own = F.try_element_at(of_role(messages, role), F.lit(-1))["content"]
    return F.coalesce(own, F.try_element_at(messages, F.lit(-1))["content"])


MESSAGES = "array<struct<role:string,content:string>>"


def answer_text(value: Column) -> Column:
    """The answer in a text that may be a JSON array of messages."""
    is_array = F.substring(F.ltrim(value), 1, 2) == "[{"
    return F.when(is_array, F.coalesce(last_of(F.from_json(value, MESSAGES)), value)).otherwise(value)


def leaks_tag(messages: Column) -> Column:
    """Whether a tag stands before the last message."""
    return F.exists(all_but_last(messages), lambda m: tag_label(m["content"]).isNotNull())


def trailing_run(messages: Column, role: str, pattern: str) -> Column:
    """How many of the last messages of a role match, counted back to the first that doesn't."""
    own = F.reverse(of_role(messages, role))
    state = F.aggregate(
        own, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, m: F.struct((s["n"] + F.when(s["on"] & m["content"].rlike(pattern), 1).otherwise(0)).alias("n"), (s["on"] & m["content"].rlike(pattern)).alias("on")),
    )
    return state["n"]


def first_json(text: Column, schema: str) -> Column:
    """struct(value, erreur): the first JSON object in a noisy text; what follows it
    is ignored.  An object without any of the fields is a value with null fields;
    ``erreur`` is the text where no object can be read."""
    at = F.instr(text, "{")
    head = F.substr(text, at)
    value = F.when((at > 0) & F.json_object_keys(head).isNotNull(), F.from_json(head, schema))
    return F.struct(value.alias("value"), F.when(value.isNull(), F.coalesce(F.substring(text, 1, 2000), F.lit(""))).alias("erreur"))
