"""Spellings of committers that mean the same person or organisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkmill.plans.lineage import cut

#: Words that say what an organisation is; a name that holds one is an organisation's.
KINDS = ("technologies", "systems", "foundation", "cloud", "research", "software", "networks")
_NOISE = frozenset("the team inc gmbh ltd llc ci bot services lab".split())
_BODY = frozenset("team inc gmbh ltd llc ci bot".split())
#: Common short forms that the table of short forms lacks (it is not complete).
_MORE = {
    "nacho": "ignacio", "sue": "susan", "debbie": "deborah", "deb": "deborah", "ed": "edward", "eddie": "edward", "ted": "theodore edward",
    "bill": "william", "will": "william", "rick": "richard", "dick": "richard", "rich": "richard", "greg": "gregory", "matt": "matthew",
    "tim": "timothy", "jim": "james", "jamie": "james", "jenny": "jennifer", "vicki": "victoria", "liza": "elizabeth", "betty": "elizabeth",
    "kat": "katherine", "nat": "natalia", "ron": "ronald", "ken": "kenneth", "larry": "lawrence", "dima": "dmitri", "nico": "nicholas",
}
#: A word is a usual given name if it stands beside this many others at least, and beside a share of all that grows as their root, unless a
#: word one letter away has ``_RATIO`` times as many (then it is that name's slip, often made). A family in so many spellings is no slip.
_GIVEN_PARTNERS, _GIVEN_SHARE, _RATIO, _FAMILY_SPELLINGS = 8, 0.25, 4, 3
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe"})
_FORMS = T.ArrayType(T.StructType([T.StructField("family", T.StringType()), T.StructField("given", T.StringType())]))


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def distance(a: str, b: str, limit: int = 1) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b within a band of ``limit``; ``limit`` + 1 if there are more."""
    if a == b:
        return 0
    n, m, far = len(a), len(b), limit + 1
    if abs(n - m) > limit:
        return far
    before: list[int] = []
    row = [j if j <= limit else far for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [far] * (m + 1)
        if i <= limit:
            new[0] = i
        for j in range(max(1, i - limit), min(m, i + limit) + 1):
            d = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, far)
        before, row = row, new
    return row[m]


def forms(name: str) -> list[tuple[str, str]]:
    """The readings (family, given) of a spelling; of an organisation (core, "#" and its kind); of what holds no family (words, "="). A family
    may have any length from two letters. A given name that is cut off keeps its dot."""
    text = re.sub(r"[\[(][^\])]*[\])]|\s-\s.*$", " ", name)
    text = text if re.search(r"[^\W_]", text) else name
    text = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-ZÀ-ÖØ-ÞŁŚŽ][^\W\d_A-Z])", " ", unicodedata.normalize("NFC", text))
    words = re.findall(r"[^\W_]+", fold(text))
    short = "gmbh" in words or text.rstrip().endswith(".")
    kind, rest = "", []
    for w in words:
        hit = next((k for k in KINDS if distance(w, k) <= 1 or short and len(w) >= 3 and k.startswith(w)), None)
        if hit and not kind:
            kind = hit
        elif w not in _NOISE and not (kind and any(distance(w, x) <= 1 for x in ("services", "lab"))):
            rest.append(w)
    if kind or _BODY & set(words):
        return [("".join(rest or [w for w in words if w not in _BODY | {"the"}] or words), "#" + kind)]
    if len(words) == 1 and len(words[0]) > 2:
        return [(words[0][1:], words[0][0])]
    spelled = [(" ".join(words), "=")] if words else []
    if len(words) > 2:
        long = [w for w in words if len(w) > 1]
        words = long if len(long) > 1 else [next(w for w in words if len(w) == 1), *long]
    if len(words) < 2:
        return spelled
    cut_off = {fold(w) for w in re.findall(r"([^\W_]{2,})\.(?=\s|$)", text)}
    first, last = " ".join(words[:-1]), words[-1]
    both = [(last, first), (first, last)] if len(words) == 2 else [(last, first), (" ".join(words[1:]), words[0])]
    if len(words) > 2 and "," in text:
        before, after = ([w for w in re.findall(r"[^\W_]+", fold(x)) if len(w) > 1] for x in text.split(",", 1))
        both += [(f, " ".join(after)) for f in (" ".join(before), *before[-1:]) if after]
    return sorted({(f, g + "." if g in cut_off else g) for f, g in both if len(f) > 1 and f not in cut_off}) or spelled


def segments(word: str) -> list[str]:
    """What the inverted index holds of a word: its two halves, each with the word's length and the half's number.

    One edit leaves one of the two halves whole (pigeonhole), moved by one place at most; only a swap of the two letters at the cut breaks both,
    for which the word with these two in the order of the alphabet is held as well.
    """
    n = len(word)
    h = n // 2
    return [f"{n}a{word[:h]}", f"{n}b{word[h:]}", _swapped(word)]


def _swapped(word: str) -> str:
    h = max(1, len(word) // 2)
    return f"{len(word)}x{word[: h - 1]}{''.join(sorted(word[h - 1 : h + 1]))}{word[h + 1 :]}"


def lookups(word: str) -> list[str]:
    """The segments of words one edit away that are no longer than ``word``: its own substrings, shifted by up to one place."""
    m = len(word)
    out = {_swapped(word)}
    for n in (m - 1, m):
        h = n // 2
        if n > 1:
            out.update(f"{n}a{word[p : p + h]}" for p in range(max(0, m - n - 1), 2) if p + h <= m)
            out.update(f"{n}b{word[p : p + n - h]}" for p in (h - 1, h, h + 1) if 0 <= p and p + n - h <= m)
    return sorted(out)


def given_keys(given: str, short: dict[str, set[str]]) -> list[str]:
    """Letters of which two given names that ``same_given`` accepts share one: the first two of the name and of its long forms, and the
    initials of its short forms. An organisation's kind is its only key, and so is "="."""
    if given[:1] in ("#", "="):
        return [given]
    given = given.rstrip(".")
    long = {given, *short.get(given, ())}
    return sorted({c for x in long for c in x[:2]} | {s[0] for s, givens in short.items() if given in givens})


def same_given(a: str, b: str, short: dict[str, set[str]], known: bool) -> bool:
    """Whether two given names or initials may be one person's; ``known``: both are usual names, so that a slip is ruled out."""
    if a == b:
        return True
    if a[0] in "#=" or b[0] in "#=":
        return False
    if a[-1] == "." or b[-1] == ".":
        stem, whole = (a[:-1], b) if a[-1] == "." else (b[:-1], a)
        if len(whole) == 1:
            return whole in stem[:2]
        return any(distance(stem, x[:n]) <= 1 for x in {whole.rstrip("."), *short.get(whole, ())} for n in range(max(2, len(stem) - 1), len(stem) + 2) if x[0] in stem[:2])
    left, right = {a, *short.get(a, ())}, {b, *short.get(b, ())}
    if len(a) == 1 or len(b) == 1:
        shorts = {s[0] for s, givens in short.items() if a in givens or b in givens}
        return bool({x[0] for x in left} & {x[0] for x in right}) or min(a, b, key=len) in shorts
    if left & right:
        return True
    if known:
        return False
    return any(min(len(x), len(y)) >= 3 and (distance(x, y) <= 1 or x.startswith(y) or y.startswith(x)) for x in left for y in right)


def short_forms(rows: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    """Short form -> given names, from (given_name, short_form) and the common ones."""
    out: dict[str, set[str]] = {}
    for given, short in [*rows, *((g, s) for s, givens in _MORE.items() for g in givens.split())]:
        out.setdefault(fold(short), set()).add(fold(given))
    return out


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, root): root is the smallest name that edges lead to, by passing the smallest label on until nothing changes."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = nodes.select("name", F.col("name").alias("root"))
    while True:
        near = both.join(labels, both.b == labels.name).groupBy("a").agg(F.min("root").alias("least"))
        new = cut(
            labels.join(near, labels.name == near.a, "left").select(
                "name", F.least("root", F.coalesce("least", "root")).alias("root"), (F.col("least") < F.col("root")).alias("moved")
            )
        )
        labels = new.select("name", "root")
        if new.filter("moved").isEmpty():
            return labels


def variants(names: DataFrame, given_names: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different values of ``names`` (one string column) that mean the same, name_a the smaller in byte order.

    1. A spelling is read as (family, given), in both orders unless one word is known as a given name, or as an organisation's core and kind.
    2. The distinct families are cut into k + 1 = 2 segments that go to an inverted index; each family looks up its own substrings, shifted by up
       to k = 1 places, and a banded edit distance verifies what it meets. Only families take part, so a family that a third of all
       spellings share is one row.
    3. The distinct readings of the same or of neighbouring families meet if their given names share one of ``given_keys``, and a pair is kept
       if the given names agree: equal, a short or cut-off form, an initial, or one edit apart. Spellings hang on their readings, so many
       spellings of one reading make as many edges, not pairs. Two families or given names that are each usual are never taken for a slip of each other.
       One edit of a family of under four letters counts only beside given names that agree without one; one changed letter of two is another name.
    4. Full names are closed to entities; a spelling with an initial joins one only if no second entity of its family (or, if
       there is none, of a neighbouring one) would do as well.

    Defined results: null and blank spellings and those without a letter or digit give no pair; what has no family (a word of under three letters,
    initials alone) pairs with the same letters in other writing. A name whose words are all given names is read with either as its family.
    """
    short = short_forms((r[0], r[1]) for r in given_names.select("given_name", "short_form").distinct().collect() if r[0] and r[1])
    listed = {*short, *(g for s in short.values() for g in s)}
    read = F.udf(forms, _FORMS, useArrow=True)
    spelled = cut(names.toDF("name").filter("name is not null and trim(name) != ''").distinct())
    rows = cut(spelled.select("name", F.explode(read("name")).alias("f")).select("name", "f.family", "f.given"))
    partners = cut(rows.groupBy("given").agg(F.count_distinct("family").alias("partners")))
    spellings = rows.groupBy("family").agg(F.count_distinct("name").alias("spellings"))
    is_listed = F.udf(lambda w: w in listed, "boolean", useArrow=True)
    enough = max(_GIVEN_PARTNERS, _GIVEN_SHARE * spelled.count() ** 0.5)
    many = partners.filter(F.col("partners") >= enough)
    near = F.udf(lambda f, g: distance(f, g) <= 1, "boolean", useArrow=True)
    index = many.select(F.explode(F.udf(segments, "array<string>", useArrow=True)("given")).alias("key"), F.col("given").alias("g"), F.col("partners").alias("p"))
    sought = many.select(F.explode(F.udf(lookups, "array<string>", useArrow=True)("given")).alias("key"), "given", "partners")
    close = index.join(sought, "key").filter("g != given").select("g", "p", "given", "partners").distinct()
    rare = close.filter(F.greatest("p", "partners") >= _RATIO * F.least("p", "partners")).filter(near("g", "given"))
    rare = rare.select(F.when(F.col("p") < F.col("partners"), F.col("g")).otherwise(F.col("given")).alias("given")).distinct()
    many = many.join(rare, "given", "left_anti").select("given", F.lit(True).alias("many"))
    usual = partners.join(many, "given", "left").select("given", (F.coalesce("many", F.lit(False)) | is_listed("given")).alias("usual"))
    usual = cut(usual)
    turned = usual.select(F.col("given").alias("family"), F.col("usual").alias("family_usual"))
    rows = rows.join(usual, "given").join(turned, "family", "left").join(spellings, "family")
    # a given name is not read as a family, if the spelling has another reading
    rows = rows.withColumn("kept", ~F.coalesce("family_usual", F.lit(False)) | F.col("usual") & ~is_listed("family")).drop("family_usual")
    rows = cut(rows.withColumn("any", F.max("kept").over(Window.partitionBy("name"))).filter("kept or not any").drop("kept", "any"))
    # families: each once, whatever the number of spellings that hold it
    families = rows.select("family", "spellings").distinct()
    held = families.select(F.explode(F.udf(segments, "array<string>", useArrow=True)("family")).alias("key"), F.col("family").alias("family_a"), F.col("spellings").alias("sa"))
    asked = families.select(F.explode(F.udf(lookups, "array<string>", useArrow=True)("family")).alias("key"), F.col("family").alias("family_b"), F.col("spellings").alias("sb"))
    slips = held.join(asked, "key").filter(f"family_a != family_b and least(sa, sb) < {_FAMILY_SPELLINGS}").select("family_a", "family_b").distinct()
    slips = cut(slips.filter(near("family_a", "family_b")))
    # readings: each once, whatever the number of spellings that have it; of the same or of neighbouring families, and with a letter in common
    node = F.concat(F.lit("\u0001"), "family", F.lit("\u0001"), "given")
    rows = rows.select("name", "family", "given", "usual", node.alias("node"), (F.length("given") == 1).alias("one"))
    readings = rows.drop("name").distinct()
    keyed = readings.withColumn("key", F.explode(F.udf(lambda g: given_keys(g, short), "array<string>", useArrow=True)("given")))
    columns = ("node", "family", "given", "usual", "one")
    left = keyed.select("key", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = keyed.select("key", *[F.col(c).alias(f"{c}_b") for c in columns])
    alike = left.withColumnRenamed("family_a", "f").join(right.withColumnRenamed("family_b", "f"), ["f", "key"]).filter("node_a < node_b")
    other = left.join(slips, "family_a").join(right, ["family_b", "key"]).filter("given_a != '=' and given_b != '='")
    # a slip in a family of under four letters counts only beside given names, not initials, that agree without a slip; two letters may be swapped
    other = other.withColumn("brief", F.expr("least(length(family_a), length(family_b)) < 4 and left(given_a, 1) != '#'"))
    other = other.filter("not brief or not one_a and not one_b and (greatest(length(family_a), length(family_b)) > 2 or family_a = reverse(family_b))")
    other = other.withColumns({c: F.col(c) | F.col("brief") for c in ("usual_a", "usual_b")})
    taken = [f"{c}_{x}" for x in "ab" for c in ("node", "given", "usual", "one")]
    met = alike.select(*taken, F.lit(True).alias("exact")).union(other.select(*taken, F.lit(False))).distinct()
    agree = F.udf(lambda a, b, known: same_given(a, b, short, known), "boolean", useArrow=True)
    pairs = cut(met.filter(agree("given_a", "given_b", F.col("usual_a") & F.col("usual_b"))).select("node_a", "node_b", "one_a", "one_b", "exact"))
    # a graph of spellings and readings: a spelling hangs on its readings, and readings that agree hang together
    nodes = cut(spelled.union(readings.select("node")).distinct())
    hangs = rows.select(F.col("name").alias("a"), F.col("node").alias("b"), "one")
    full = hangs.filter("not one").select("a", "b").union(pairs.filter("not one_a and not one_b").select("node_a", "node_b"))
    entity = cut(_components(nodes, full))
    mixed = pairs.filter("one_a != one_b").select(
        F.when(F.col("one_a"), F.col("node_a")).otherwise(F.col("node_b")).alias("node"), F.when(F.col("one_a"), F.col("node_b")).otherwise(F.col("node_a")).alias("other"), "exact"
    )
    same = F.when(F.col("exact"), F.col("root"))  # an entity of the very family goes before those of neighbouring ones
    found = mixed.join(entity.withColumnRenamed("name", "other"), "other").select("node", "exact", "root").distinct()
    initials = rows.groupBy("name").agg(F.min("one").alias("all")).filter("all").select("name")
    reach = rows.filter("one").select("name", "node").join(initials, "name", "left_semi").join(found, "node").groupBy("name").agg(
        F.count_distinct("root").alias("n"), F.min("root").alias("root"), F.count_distinct(same).alias("k"), F.min(same).alias("same")
    )
    reach = cut(reach)
    sure = reach.filter("k = 1 or k = 0 and n = 1").select(F.col("name").alias("a"), F.coalesce("same", "root").alias("b"))
    alone = initials.join(reach, "name", "left_anti")
    left_over = cut(hangs.filter("one").join(alone.select(F.col("name").alias("a")), "a", "left_semi").select("a", "b"))
    kept = left_over.select("b").distinct()
    among = pairs.filter("one_a and one_b").select("node_a", "node_b").join(kept.select(F.col("b").alias("node_a")), "node_a", "left_semi").join(kept.select(F.col("b").alias("node_b")), "node_b", "left_semi")
    entity = cut(_components(nodes, full.union(sure).union(left_over).union(among.select("node_a", "node_b"))))
    entity = entity.join(spelled, "name", "left_semi")
    other = entity.select(F.col("name").alias("name_b"), "root")
    return entity.withColumnRenamed("name", "name_a").join(other, "root").filter("name_a < name_b").select("name_a", "name_b")


def committers(changes: DataFrame, base: DataFrame, target: DataFrame) -> DataFrame:
    """The committer spellings of the three fields, each once."""
    revised = changes.select(F.explode("revisions").alias("r")).select(F.col("r.committer").alias("name"))
    return revised.union(base.select("committer")).union(target.select("committer")).distinct()
