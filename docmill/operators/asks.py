"""What models are asked for on the way: imagined answers, variants of questions, suggestions, verdicts on texts, corrections, contexts.
Each is a prompt as a column, a call (``models.completed``) and a reading of the reply; a reply that says nothing leaves things as they were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions import text as tx

from .models import TextModel, completed
from .passes import DOCUMENT

Factory = Callable[[], TextModel]


def _prompt(task: str, *parts: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(task), *parts)


def imagined(question: Column, model: Factory) -> Column:
    """A short answer as a document might give it, to search for in place of the question; the question where there is none."""
    reply = F.trim(completed(_prompt("Write a short passage that could answer the question below, as if it came from a reference text.", question), model, 220))
    return F.when(reply == "", question).otherwise(reply)


def imagined_list(question: Column, model: Factory) -> Column:
    """The same for questions that want a list: names and terms that an answer would hold; they stand behind the question."""
    reply = F.trim(completed(_prompt("Name, on one line, items and terms that a list answering the request below would hold.", question), model, 160))
    return F.when(reply == "", question).otherwise(F.concat(question, F.lit(" "), reply))


def variants(question: Column, model: Factory, n: int) -> Column:
    """The question and up to ``n`` other wordings, each once."""
    reply = completed(_prompt(f"Give {n} other wordings of the question below, one a line.", question), model, 200)
    return F.array_distinct(F.concat(F.array(question), tx.list_lines(reply, question, n)))


def suggested(topics: Column, model: Factory, n: int) -> Column:
    """Up to ``n`` questions that a reader could ask about the topics."""
    return tx.suggestions(completed(_prompt(f"Suggest {n} particular questions about the topics below, one a line.", topics), model, 300), n)


def inspected(text: Column, model: Factory) -> Column:
    """clean, partial, garbled or unknown."""
    return tx.verdict(completed(_prompt("Is the text below clean, partial or garbled? Answer with one word.", text), model, 10))


def corrected(text: Column, around: Column, model: Factory) -> Column:
    """The text as it was meant to be, or null where the model gives it up or talks about it instead."""
    reply = completed(_prompt("Restore the damaged text below. Answer UNRECOVERABLE if that can't be done. Text around it:", around, F.lit("Text:"), text), model, 2000)
    return F.when(tx.acceptable_correction(reply), tx.without_fences(reply))


def situated(chunk: Column, document: Column, model: Factory) -> Column:
    """A sentence about the place of a chunk in its document, of which the model sees the beginning."""
    return F.trim(completed(_prompt("In one sentence, where in this document does the chunk stand?", F.substring(document, 1, DOCUMENT), F.lit("Chunk:"), chunk), model, 120))
