"""Tab-divided rows checked by patterns that are generated from a schema.

A row is first matched as a whole by one anchored pattern. Rows that don't match go through the
schema's field-prefix patterns, each one field longer than the one before; the first prefix that
doesn't match names the broken field.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
STOP = r"(?=\t|\z)"
ANY = rf'(?:{QUOTED}{STOP}|(?!")[^\t]*+)'


def _at_most(bound: str) -> str:
    """Digits without leading zeros, up to the bound (a pattern built digit by digit)."""
    same = "|".join(
        f"{bound[:i]}[{'1' if i == 0 else '0'}-{int(d) - 1}][0-9]{{{len(bound) - i - 1}}}"
        for i, d in enumerate(bound)
        if int(d) > (i == 0)
    )
    return f"(?=[0-9])0*+(?:[1-9][0-9]{{0,{len(bound) - 2}}}(?![0-9])|(?:{same}|{bound})(?![0-9]))?+(?![0-9])"


INTEGER = f"(?:-{_at_most(str(2**63))}|{_at_most(str(2**63 - 1))})"
INTEGERS = f"{INTEGER}(?:,{INTEGER})*+,?+"


@dataclass(frozen=True)
class Field:
    """kind: ``text``, ``integer``, ``integers`` (comma list, one trailing comma allowed) or ``choice``."""

    name: str
    kind: str = "text"
    choices: str = ""
    reason: str = ""

    @property
    def pattern(self) -> str:
        plain = {"text": "", "integer": INTEGER, "integers": INTEGERS, "choice": f"[{self.choices}]"}[self.kind]
        return f'(?:(?:{plain}|"{plain}"){STOP})' if plain else ANY


@dataclass(frozen=True)
class RowSchema:
    fields: tuple[Field, ...]
    #: Reasons in the order in which they apply.
    reasons: tuple[str, ...] = field(default=())

    @property
    def whole(self) -> str:
        return r"\A" + r"\t".join(f.pattern for f in self.fields) + r"\z"

    @property
    def quoted_right(self) -> str:
        return rf"\A{ANY}(?:\t{ANY})*+\z"

    @property
    def right_count(self) -> str:
        return rf"\A{ANY}(?:\t{ANY}){{{len(self.fields) - 1}}}\z"

    def prefixes(self, upto: int) -> list[tuple[int, str]]:
        """(field number, pattern) of the prefixes that end in a field whose reason is reasons[upto]."""
        known, out, so_far = set(self.reasons[: upto + 1]), [], []
        for i, f in enumerate(self.fields):
            so_far.append(f.pattern if f.reason in known else ANY)
            if f.reason == self.reasons[upto]:
                out.append((i, r"\A" + r"\t".join(so_far) + STOP))
        return out

    def failure(self, line: Column) -> Column:
        """struct(reason, field) of a row, null where the whole pattern matches."""

        def bad(reason: str, name: str | None) -> Column:
            return F.struct(F.lit(reason).alias("reason"), F.lit(name).cast("string").alias("field"))

        out = F.when(line.rlike(self.whole), None)
        out = out.when(~line.rlike(self.quoted_right), bad("quoting", None))
        out = out.when(~line.rlike(self.right_count), bad("columns", None))
        for k, reason in enumerate(self.reasons):
            for i, pattern in self.prefixes(k):
                out = out.when(~line.rlike(pattern), bad(reason, self.fields[i].name))
        return out

    def values(self, line: Column) -> Column:
        """The fields' texts, quotes taken off."""
        found = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(rf"\t({ANY})"), F.lit(1))
        bare = F.transform(
            found,
            lambda v: F.when(v.startswith('"'), F.replace(v.substr(F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v),
        )
        return F.when(F.contains(line, F.lit('"')), bare).otherwise(F.split(line, "\t", -1))


def integers(text: Column) -> Column:
    """A comma list as array<bigint>; one trailing comma is not a divider."""
    return F.transform(F.split(F.regexp_replace(text, r",\z", ""), ",", -1), lambda v: v.cast("bigint"))


def with_new_names(df: DataFrame, names: list[str], mark: str = "in_") -> DataFrame:
    """Renames the input's columns that clash with names the operator adds."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    renamed = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = mark + c
            while new.lower() in taken:
                new = mark + new
            taken.add(new.lower())
            renamed[c] = new
    return df.withColumnsRenamed(renamed)
