"""Parsing expression grammars that compile to Java regular expressions.

Ordered choice and repetition become atomic groups and possessive quantifiers, so that a choice, once made, is
not taken back and matching takes linear time and constant stack; only a failing alternative backtracks to
the next one. The compiled grammar runs inside the JVM's regexp functions.
"""

from __future__ import annotations

import re


class Rule:
    """One expression; its pattern is a unit to which a quantifier can be attached."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def __add__(self, other: Rule) -> Rule:
        return Rule(f"(?>{self.pattern}{other.pattern})")

    def __truediv__(self, other: Rule) -> Rule:
        return Rule(f"(?>{self.pattern}|{other.pattern})")


def text(literal: str) -> Rule:
    return Rule(f"(?:{re.escape(literal)})")


def choice(*rules: Rule) -> Rule:
    """The first of the rules that matches."""
    return Rule(f"(?>{'|'.join(r.pattern for r in rules)})")


def one_of(members: str) -> Rule:
    """A character of a class, given as the inside of its brackets."""
    return Rule(f"[{members}]")


def none_of(members: str) -> Rule:
    return Rule(f"[^{members}]")


def many(rule: Rule) -> Rule:
    return Rule(f"(?:{rule.pattern}*+)")


def some(rule: Rule) -> Rule:
    return Rule(f"(?:{rule.pattern}++)")


def maybe(rule: Rule) -> Rule:
    return Rule(f"(?:{rule.pattern}?+)")


def ahead(rule: Rule) -> Rule:
    return Rule(f"(?={rule.pattern})")


def not_ahead(rule: Rule) -> Rule:
    return Rule(f"(?!{rule.pattern})")


def behind(rule: Rule) -> Rule:
    return Rule(f"(?<={rule.pattern})")


def not_behind(rule: Rule) -> Rule:
    return Rule(f"(?<!{rule.pattern})")


END = Rule(r"\z")
