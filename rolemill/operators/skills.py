"""Skill gazetteer and skill extraction."""

import re
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rolemill import vocab

# A gazetteer is a dimension table; beyond this many aliases one alternation
# regex stops being the right tool, so loading it is refused, not truncated.
MAX_ALIASES = 20_000


def alias_table(taxonomy: DataFrame) -> DataFrame:
    """(alias, skill, category) with one owner per alias.

    ``taxonomy`` has (skill_id, name, category, aliases). Names count as their
    own alias; characters outside the allowed set disqualify an alias; the
    skill that comes first in the taxonomy keeps a shared alias.
    """
    rows = taxonomy.select(
        "skill_id", F.col("name").alias("skill"), "category",
        F.posexplode(F.concat(F.array("name"),
                              F.coalesce("aliases", F.array().cast("array<string>")))))
    alias = F.lower(F.trim("col"))
    order = Window.partitionBy("alias").orderBy("skill_id", "pos")
    return (rows.withColumn("alias", alias)
            .where((F.col("alias") != "")
                   & F.col("alias").rlike(vocab.ALIAS_ALLOWED))
            .withColumn("rn", F.row_number().over(order))
            .where("rn = 1")
            .select("alias", "skill", "category"))


def _prefix_tree(words) -> str:
    """One regex for all words, longest first, sharing common prefixes.

    Means the same as an alternation sorted by length but tests a first letter
    once instead of once per word.
    """
    tree = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def render(node):
        arms = [re.escape(ch) + render(rest)
                for ch, rest in sorted(node.items()) if ch]
        if not arms:
            return ""
        body = arms[0] if len(arms) == 1 and "" not in node else f"(?:{'|'.join(arms)})"
        return body + "?" if "" in node else body

    return render(tree)


@dataclass(frozen=True)
class SkillMatcher:
    """Alias lookup plus the alternation regex built from it."""

    aliases: dict
    categories: dict

    @classmethod
    def from_taxonomy(cls, taxonomy: DataFrame) -> "SkillMatcher":
        rows = alias_table(taxonomy).limit(MAX_ALIASES + 1).collect()
        if len(rows) > MAX_ALIASES:
            raise ValueError(f"the taxonomy has more than {MAX_ALIASES} aliases")
        return cls({r.alias: r.skill for r in rows},
                   {r.skill: r.category for r in rows})

    @classmethod
    def from_rows(cls, rows) -> "SkillMatcher":
        """From (name, category, aliases) tuples held in the program."""
        aliases, categories = {}, {}
        for name, category, others in rows:
            categories[name] = category
            for alias in (name, *others):
                key = alias.lower().strip()
                if re.match(vocab.ALIAS_ALLOWED, key):
                    aliases.setdefault(key, name)
        return cls(aliases, categories)

    @property
    def pattern(self) -> str:
        # The first letters are looked at before the costlier look behind.
        starts = "".join(f"[{''.join(re.escape(ch) for ch in sorted(chars))}]" for chars in (
            {a[0] for a in self.aliases},
            {a[1] for a in self.aliases} if min(map(len, self.aliases)) > 1 else ()) if chars)
        return (rf"(?={starts})(?<![\p{{L}}\p{{N}}_+#])(" + _prefix_tree(self.aliases)
                + r")(?![\p{L}\p{N}_+#])")

    @property
    def python_pattern(self) -> str:
        """``pattern`` for Python, whose ``\\w`` are all letters and figures and the underline."""
        return rf"(?<![\w+#])(?:{_prefix_tree(self.aliases)})(?![\w+#])"

    def skill_of(self, alias: Column) -> Column:
        lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(
            self.aliases.items())])
        return F.try_element_at(lookup, alias)

    def category_of(self, skill: Column) -> Column:
        lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(
            self.categories.items())])
        return F.try_element_at(lookup, skill)


def requirement_class(text: str, start: int, firsts: tuple[list, list]) -> str:
    """Class of a mention from the lower-cased text just before it.

    Looks at the first required heading and the first preferred heading in the
    window, and headings may sit inside longer words. ``firsts`` has the preferred and
    the required headings the text holds, each with its length and the place of its first
    occurrence, so a window that begins with the text needs no search of its own.
    """
    begin = start - vocab.HEADING_WINDOW
    first = []
    for heads in firsts:
        least = start
        for at, size, word in heads:
            if at + size <= start:
                if at < begin:
                    at = text.find(word, begin, start)
                if 0 <= at < least:
                    least = at
        first.append(least)
    preferred, required = first
    if preferred < start and (required == start or preferred > required):
        return "preferred"
    return "required" if required < start else "mentioned"


_SKILLS = "array<struct<name:string,requirement:string,mention_count:bigint>>"
# Texts held as Python strings at once.
_SLICE_ROWS = 512


def _summary(text: str, mentions: re.Pattern, skill_of: dict) -> dict:
    """Class and count per skill of a lower-cased text."""
    found, firsts = {}, None
    for hit in mentions.finditer(text):
        name = skill_of[hit.group()]
        cls, n = found.get(name, ("mentioned", 0))
        if cls == "mentioned":
            if firsts is None:
                firsts = tuple([(at, len(w), w) for w in words if (at := text.find(w)) >= 0]
                               for words in (vocab.PREFERRED_WORDS, vocab.REQUIRED_WORDS))
            cls = requirement_class(text, hit.start(), firsts)
        found[name] = (cls, n + 1)
    return found


def _summaries(matcher: SkillMatcher):
    skill_of, pattern = matcher.aliases, matcher.python_pattern

    # Not an iterator: Spark runs it in one step with other helpers that read the same text.
    @F.arrow_udf(_SKILLS)
    def summaries(texts: pa.Array) -> pa.Array:
        mentions = re.compile(pattern)
        names, classes, counts, ends = [], [], [], [0]
        for at in range(0, len(texts), _SLICE_ROWS):
            for text in texts.slice(at, _SLICE_ROWS).to_pylist():
                for name, (cls, n) in _summary(text or "", mentions, skill_of).items():
                    names.append(name)
                    classes.append(cls)
                    counts.append(n)
                ends.append(len(names))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(classes, pa.string()), pa.array(counts, pa.int64())],
            ["name", "requirement", "mention_count"]))
    return summaries


def skills_in(text: Column, matcher: SkillMatcher) -> Column:
    """``array<struct<name, requirement, mention_count>>`` of a text, without a shuffle.

    An Arrow helper finds the mentions and walks them. Java's search for them took a fifth
    of the samples of a whole enrichment."""
    if not matcher.aliases:
        return F.array().cast(_SKILLS)
    return _summaries(matcher)(F.lower(text))


def with_skills(df: DataFrame, matcher: SkillMatcher, text: str = "description_text",
                into: str = "skills") -> DataFrame:
    """Add ``skills_in`` of a column, row by row."""
    return df.withColumn(into, skills_in(F.col(text), matcher))


def job_skills(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Bridge rows (job, skill, requirement, mention_count)."""
    return jobs.select(key, F.explode("skills").alias("s")).select(
        key, F.col("s.name").alias("skill"), F.col("s.requirement").alias("requirement"),
        F.col("s.mention_count").alias("mention_count"))


def job_benefits(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    return jobs.select(key, F.explode("benefits").alias("benefit"))
