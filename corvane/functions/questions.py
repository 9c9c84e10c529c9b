"""Questions and phrases from action phrases, methods, calls and function names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .fixed import FUNCTION_ACTIONS, LIFECYCLE_METHODS, METHOD_PREFIXES, METHOD_SUFFIXES, VERBS


def _verb_of(noun: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair]), noun)


def class_to_question(phrase: Column) -> Column:
    """Question for an action phrase: its last word gives the verb, the rest the subject; null for an empty phrase."""
    words = F.split(F.trim(phrase), r"\s+")
    verb = _verb_of(F.element_at(words, -1))
    subject = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    return (
        F.when(phrase.isNull() | (F.trim(phrase) == ""), F.lit(None).cast("string"))
        .when(verb.isNull(), F.concat(F.lit("How do you use "), phrase, F.lit("?")))
        .when(subject == "", F.concat(F.lit("How do you "), verb, F.lit("?")))
        .otherwise(F.concat(F.lit("How do you "), verb, F.lit(" "), text.with_article(subject), F.lit("?")))
    )


def _skipped(method: Column) -> Column:
    return F.startswith(method, F.lit("Get")) | method.isin(*LIFECYCLE_METHODS)


def method_to_question(method: Column, phrase: Column) -> Column:
    """Question for a method of what the phrase names; null for getters and lifecycle methods."""
    of = text.with_article(phrase)
    out = F.when(method.isNull() | _skipped(method), F.lit(None).cast("string"))
    for prefix, verb, article, preposition, _ in METHOD_PREFIXES:
        thing = text.camel_to_words(F.substr(method, F.lit(len(prefix) + 1)))
        full = F.concat(F.lit(f"How do you {verb} {article} "), thing, F.lit(f" {preposition} "), of, F.lit("?"))
        out = out.when(F.startswith(method, F.lit(prefix)), F.when(thing == "", F.concat(F.lit(f"How do you {verb} "), of, F.lit("?"))).otherwise(full))
    for suffix, verb, _ in METHOD_SUFFIXES:
        thing = text.camel_to_words(F.substring(method, F.lit(1), F.length(method) - len(suffix)))
        out = out.when(F.endswith(method, F.lit(suffix)), F.concat(F.lit(f"How do you {verb} "), thing, F.lit(" on "), of, F.lit("?")))
    return out.otherwise(F.concat(F.lit("How do you "), text.camel_to_words(method), F.lit(" "), of, F.lit("?")))


def call_to_phrase(method: Column, args: Column) -> Column:
    """Phrase for a call with its arguments as texts; null where it describes no configuration."""
    joined = F.array_join(args, ", ")
    out = F.when(method.isNull() | _skipped(method), F.lit(None).cast("string"))
    for prefix, *_, done in METHOD_PREFIXES:
        thing = text.camel_to_words(F.substr(method, F.lit(len(prefix) + 1)))
        plain = F.when(thing == "", F.lit(done)).otherwise(F.concat(thing, F.lit(f" {done}")))
        if prefix == "Set":
            shown = F.when(F.size(args) == 1, joined).otherwise(F.concat(F.lit("("), joined, F.lit(")")))
            plain = F.when(F.size(args) > 0, F.concat(thing, F.lit(f" {done} "), shown)).otherwise(plain)
        out = out.when(F.startswith(method, F.lit(prefix)), plain)
    for suffix, _, done in METHOD_SUFFIXES:
        out = out.when(F.endswith(method, F.lit(suffix)), F.concat(text.camel_to_words(F.substring(method, F.lit(1), F.length(method) - len(suffix))), F.lit(f" {done}")))
    return out.when(F.size(args) > 0, F.concat(text.camel_to_words(method), F.lit(" with "), joined))


def function_to_question(name: Column) -> Column:
    """Question for a helper function's name, split at underscores, or else at capitals."""
    snake = F.filter(F.split(name, "_"), lambda p: p != "")
    parts = F.when(F.size(snake) == 1, F.regexp_extract_all(name, F.lit("[a-z]+|[A-Z][a-z]*"), F.lit(0))).otherwise(snake)
    low = F.transform(parts, lambda p: F.lower(p))
    subject = F.array_join(F.slice(low, F.lit(2), F.greatest(F.size(low) - 1, F.lit(0))), " ")
    article = F.when(F.substring(subject, 1, 1).isin(*"aeiou"), F.lit("an ")).otherwise(F.lit("a "))
    return (
        F.when(F.size(parts) < 2, F.concat(F.lit("how to use "), name))
        .when(F.get(low, F.lit(0)).isin(*FUNCTION_ACTIONS), F.concat(F.lit("how to "), F.get(low, F.lit(0)), F.lit(" "), article, subject))
        .otherwise(F.concat(F.lit("how to use "), F.array_join(low, " ")))
    )
