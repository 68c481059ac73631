"""Prompt templates as column expressions.

The wording is a default: every function that renders a prompt takes another
template with the same slots.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBJECT = "citizenship and immigration policy"

REWRITE = """
{chat_history}

The list above is what two people have written so far. Next comes: {question}

Turn what is wanted now into a self-contained line for a semantic search engine. Return that line only.
"""

REWRITE_KNN = """
{chat_history}

The list above is what two people have written so far. Next comes: {question}

Turn what is wanted now into a self-contained line for a semantic search engine that returns its 4 closest texts, and mention in the line that there should be 4. Return that line only.
"""

GATE = """
You sort incoming messages. Only those about {subject} go through. Spam, insults and small talk do not.

Earlier messages: {chat_history}
New message: {question}

For instance, "How long does a renewal take?" goes through whenever renewals were the topic, and "Which team won?" never does.
Does the new message go through? Write yes or no.
"""

ANSWER = """
Material found in the archive:
{context}

Earlier messages: {chat_history}
New message from "user": {question}

Write what "assistant" says next. Rely on the material where it helps, without speaking of it, and start with the point itself. Two or three sentences do unless "user" wants more. If the material and the messages leave the matter open, admit that. Anything outside {subject} is politely turned down.
"""

TEMPLATES = {"rewrite": REWRITE, "rewrite_knn": REWRITE_KNN, "gate": GATE, "answer": ANSWER}


def _pieces(template: str) -> list[tuple[str, bool]]:
    parts = re.split(r"\{(\w+)\}", template)
    return [(text, i % 2 == 1) for i, text in enumerate(parts) if text or i % 2 == 1]


def render(template: str, **slots: Column | str) -> Column:
    """Fill the named slots of a template; a NULL slot leaves its place empty."""
    filled = []
    for text, is_slot in _pieces(TEMPLATES.get(template, template)):
        if not is_slot:
            filled.append(F.lit(text))
            continue
        if text not in slots:
            raise KeyError(f"template slot {text!r} is not filled")
        value = slots[text]
        filled.append(F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit("")))
    return F.concat(*filled)


def literal_text(c: Column) -> Column:
    """A string as a quoted literal: double quotes only around text that holds single quotes alone."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(code))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def literal_message(role: Column, content: Column) -> Column:
    """A message the way a list of messages prints: ``{'role': 'user', 'content': '...'}``."""
    return F.concat(
        F.lit("{'role': "), literal_text(role), F.lit(", 'content': "), literal_text(content), F.lit("}")
    )
