"""Linking the spellings of one person or organisation.

Spellings of one scope (say, role and jurisdiction) are compared if the q-grams of the tokens they are looked up by may be
near enough: grams are ordered rarest first, and two tokens that are near share a gram of their prefixes, so that an
equi-join on prefix grams loses no pair whose surnames are close. Pairs are verified by soft weighted token similarity,
where rare tokens count more. Entities are then built from the spellings that say most; one that says less joins an entity
only if it fits no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import names as N
from docketry.llm.components import components
from docketry.session import materialize

#: Spellings whose families share a bucket, about.
BUCKET_FORMS = 5_000
#: Jaccard similarity of the q-grams below which the spellings of bodies are not compared.
BODY_GRAM_SHARE = 0.3
#: Soft weighted token similarity that links two spellings, and how much nearer the best of several must be.
LINK, MARGIN = 0.75, 0.05


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("heads", T.ArrayType(T.StringType()))]))
def _read(texts: pd.Series) -> pd.DataFrame:
    known: dict[str | None, tuple] = {}
    rows = []
    for t in texts:
        if t not in known:
            n = N.read(t)
            known[t] = (n.form, n.kind, N.heads(n) if n.kind != "nobody" else [])
        rows.append(known[t])
    return pd.DataFrame(rows, columns=["form", "kind", "heads"])


def spellings(rows: DataFrame, scope: list[Column], text: Column) -> DataFrame:
    """(scope, text, form, heads): each distinct typed text of a scope, read once; fields naming nobody are dropped.

    Rows with a null part of the scope or a null text are dropped."""
    distinct = rows.select(F.concat_ws("\x1f", *scope).alias("scope"), text.alias("text"), F.array(*scope).alias("_s")).filter(F.col("text").isNotNull() & ~F.exists("_s", lambda x: x.isNull()))
    read = distinct.select("scope", "text").distinct().withColumn("r", _read("text"))
    return read.select("scope", "text", "r.form", "r.heads", "r.kind").filter("kind != 'nobody'").drop("kind")


def _grams(word: Column) -> Column:
    """Distinct padded 2-grams of the words of a head."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(F.split(word, " "), of)))


#: grams_lost() by length; longer words may lack all but one.
_LOST = [N.grams_lost(n) for n in range(65)]


def _heads(forms: DataFrame) -> DataFrame:
    """(scope, form, role, word, grams, need): need is how many grams anything near must share at least."""
    each = forms.select("scope", "form", F.explode("heads").alias("h")).select("scope", "form", F.substring("h", 1, 1).alias("role"), F.expr("substring(h, 3)").alias("word")).withColumn("grams", _grams(F.col("word")))
    lost = F.try_element_at(F.array(*[F.lit(n) for n in _LOST]), F.length("word") + 1)
    size = F.size("grams")
    need = F.when(F.col("role") == "b", F.ceil(size * BODY_GRAM_SHARE)).otherwise(F.greatest(F.lit(1), size - F.coalesce(lost, size)))
    return each.withColumn("need", need.cast("int"))


def _prefixes(heads: DataFrame, order: DataFrame) -> DataFrame:
    """(scope, form, role, word, gram) for the rarest grams of every head, as many as the need asks for; grams that order
    lacks are shared by nothing."""
    each = heads.select("scope", "form", "role", "word", "need", F.explode("grams").alias("gram")).join(order, "gram")
    listed = each.groupBy("scope", "form", "role", "word", "need").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    keep = F.size("g") - F.col("need") + 1
    return listed.filter(keep > 0).select("scope", "form", "role", "word", F.explode(F.slice("g", F.lit(1), keep)).alias("x")).select("scope", "form", "role", "word", F.col("x.gram").alias("gram"))


def gram_order(forms: DataFrame) -> DataFrame:
    """(gram, n): how many heads have a gram."""
    return _heads(forms).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def candidates(left: DataFrame, right: DataFrame, order: DataFrame) -> DataFrame:
    """(scope, form_a, form_b): pairs of one scope with a near head in common. Loses no pair whose surnames are as close as
    SURNAME_CLOSE asks for, nor one that is close when one name has its family name among the given ones; given names meet
    no given names."""
    roles = lambda s, g: F.when(F.col("role") == "s", F.array(F.lit("ss"), F.lit(s))).when(F.col("role") == "g", F.array(F.lit(g))).otherwise(F.array(F.lit("bb")))
    side = lambda x, c, s, g: _prefixes(_heads(x), order).select("scope", F.explode(roles(s, g)).alias("meet"), "gram", F.col("form").alias(f"form_{c}"), F.col("word").alias(f"word_{c}"))
    a, b = side(left, "a", "sg", "gs"), side(right, "b", "gs", "sg")
    longest = F.greatest(F.length("word_a"), F.length("word_b"))
    # letters that change places are two plain edits
    allowed = lambda close: F.floor((1 - close) * longest + 1e-9).cast("int")
    edits = F.when(F.col("meet") == "ss", allowed(N.SURNAME_CLOSE)).otherwise(allowed(N.REORDERED_CLOSE))
    near_length = (F.col("meet") == "bb") | (F.abs(F.length("word_a") - F.length("word_b")) <= edits)
    met = a.join(b, ["scope", "meet", "gram"]).filter(near_length).select("scope", "meet", "form_a", "form_b", "word_a", "word_b").distinct()
    near = (F.col("meet") == "bb") | (F.levenshtein("word_a", "word_b") <= 2 * edits)
    return met.filter(near).select("scope", "form_a", "form_b").distinct()


def weigh(forms: DataFrame, registry: DataFrame) -> DataFrame:
    """forms (scope, form, ...) with weights: token to the logarithm of how rare it is among the registry's forms. A token
    that the registry lacks weighs as much as one that a single form has."""
    split = lambda f: f.select("scope", "form", F.explode(F.array_distinct(F.split("form", r"[| ]"))).alias("token")).filter("token != ''")
    counts = split(registry).groupBy("token").agg(F.count("*").alias("n"))
    total = registry.count()
    each = split(forms).join(counts, "token", "left").withColumn("w", F.log(1 + F.lit(float(total)) / F.coalesce("n", F.lit(1))))
    weights = each.groupBy("scope", "form").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("weights"))
    return forms.join(weights, ["scope", "form"])


def _scored(nicknames: dict[str, tuple[str, ...]]):
    """Likeness of every pair, and whether the two names contradict each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, known = N.Given(nicknames), {}

        def read(form: str, weights: pa.Array, row: int) -> tuple[N.Name, dict[str, float]]:
            if form not in known:
                known[form] = (N.from_form(form), dict(weights[row].as_py()))
            return known[form]

        for batch in batches:
            score, against = [], []
            weights_a, weights_b = batch.column("weights_a"), batch.column("weights_b")
            for i, (a, b) in enumerate(zip(batch.column("form_a").to_pylist(), batch.column("form_b").to_pylist(), strict=True)):
                (x, of_x), (y, of_y) = read(a, weights_a, i), read(b, weights_b, i)
                s = N.likeness(x, y, lambda t: of_x.get(t) or of_y[t], given)  # noqa: B023
                score.append(s)
                against.append(s < 1 and N.contradict(x, y, given))
            yield pa.RecordBatch.from_arrays([batch.column("scope"), batch.column("form_a"), batch.column("form_b"), pa.array(score, pa.float64()), pa.array(against, pa.bool_())], ["scope", "form_a", "form_b", "score", "against"])

    return run


def _score(pairs: DataFrame, left: DataFrame, right: DataFrame, nicknames: dict[str, tuple[str, ...]]) -> DataFrame:
    """pairs with score and against; left and right are weigh()'s."""
    a, b = (x.select("scope", F.col("form").alias(f"form_{c}"), F.col("weights").alias(f"weights_{c}")) for c, x in (("a", left), ("b", right)))
    both = pairs.join(a, ["scope", "form_a"]).join(b, ["scope", "form_b"]).select("scope", "form_a", "form_b", "weights_a", "weights_b")
    # pairs are few bytes and much work, so they are spread over all cores and not merged by size; those of one spelling
    # together, as what was read and compared is kept
    both = both.repartition(2 * both.sparkSession.sparkContext.defaultParallelism, "scope", "form_b")
    return both.mapInArrow(_scored(nicknames), "scope string, form_a string, form_b string, score double, against boolean")


def _entities(nicknames: dict[str, tuple[str, ...]]):
    """Entities among nodes (form, numbers) that hang together, from their links; the more a form says, the earlier it is
    placed. What is compared grows with the links, not with the square of the nodes."""

    def solve(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        """The families of a bucket, one after another."""
        given = N.Given(nicknames)
        of = dict(tuple(links.groupby("family")))
        none = links.iloc[:0]
        solved = [family(part, of.get(name, none), given) for name, part in rows.groupby("family")]
        return pd.concat(solved) if solved else pd.DataFrame(columns=["scope", "form", "number_key", "root"])

    def family(rows: pd.DataFrame, links: pd.DataFrame, given: N.Given) -> pd.DataFrame:
        forms, numbers = rows["form"].tolist(), [set(x) for x in rows["numbers"]]
        read = {f: N.from_form(f) for f in set(forms)}
        near: dict[str, list[tuple[str, float]]] = {f: [(f, 1.0)] for f in read}
        for a, b, s in zip(links["form_a"], links["form_b"], links["score"], strict=True):
            near[a].append((b, s))
            near[b].append((a, s))
        placed: dict[str, list[int]] = {f: [] for f in read}
        whole: dict[int, list[int]] = {}
        entity_of: dict[int, int] = {}
        holder: dict[str, int] = {}

        def clash(one: list[int], other: list[int]) -> bool:
            """Whether two entities can't be one: two numbers of a kind, or names that contradict each other."""
            for a in one:
                for b in other:
                    if numbers[a] & numbers[b]:
                        continue
                    if {x[0] for x in numbers[a]} & {x[0] for x in numbers[b]} or N.contradict(read[forms[a]], read[forms[b]], given):
                        return True
            return False

        def fits(node: int) -> list[tuple[float, int]]:
            same = [entity_of[holder[x]] for x in sorted(numbers[node]) if x in holder]
            if same:
                return [(2.0, same[0])]
            best: dict[int, float] = {}
            for f, s in near[forms[node]]:
                for other in placed[f]:
                    e = entity_of[other]
                    best[e] = max(best.get(e, 0.0), s)
            return sorted(((s, e) for e, s in best.items() if not clash([node], whole[e])), reverse=True)

        how_many = rows.groupby("form")["n"].sum().to_dict()
        # of one spelling, nodes with numbers first: what has none is ambiguous between them
        for node in sorted(range(len(forms)), key=lambda k: (-N.rank(read[forms[k]]), -how_many[forms[k]], forms[k], not numbers[k], sorted(numbers[k]))):
            found = fits(node)
            if len(found) > 1 and not any(clash(whole[i], whole[j]) for _, i in found for _, j in found if i < j):
                # what it fits is one entity then
                first = found[0][1]
                for _, e in found[1:]:
                    for m in whole.pop(e):
                        entity_of[m] = first
                        whole[first].append(m)
                found = found[:1]
            e = found[0][1] if found and (len(found) == 1 or found[0][0] - found[1][0] >= MARGIN) else node
            whole.setdefault(e, []).append(node)
            entity_of[node] = e
            placed[forms[node]].append(node)
            for x in numbers[node]:
                holder.setdefault(x, node)
        names = {e: min((forms[m], ",".join(sorted(numbers[m]))) for m in members) for e, members in whole.items()}
        out = [(rows["scope"].iloc[0], forms[k], ",".join(sorted(numbers[k])), "\x1e".join(names[entity_of[k]])) for k in range(len(forms))]
        return pd.DataFrame(out, columns=["scope", "form", "number_key", "root"])

    return solve


def entities(rows: DataFrame, id_col: str, scope: list[Column], text: Column, numbers: list[Column], nicknames: dict[str, tuple[str, ...]] = N.NICKNAMES) -> tuple[DataFrame, DataFrame]:
    """Entities of a registry: (id, scope, form, entity), and its forms with their entities, (scope, form, heads, weights,
    entity).

    entity is the smallest id of the rows whose spelling belongs together. Rows that share a number of one kind and
    scope are one entity even under different spellings; rows with two different numbers of a kind never are because of
    their names, also if the names are equal. Rows that name nobody, or have a null scope, are entities of their own.
    Spellings are read and compared once, however many rows have them; one task resolves the spellings of one scope that
    hang together, which are those of one family name, from their links. nicknames: short forms of given names."""
    named = rows.select(F.col(id_col).alias("id"), F.concat_ws("\x1f", *scope).alias("scope"), text.alias("text"), F.array_sort(F.array_compact(F.array(*[F.when(F.trim(n) != "", F.concat(F.lit(f"{i}:"), F.lower(F.trim(n)))) for i, n in enumerate(numbers)]))).alias("numbers"))
    read = spellings(rows, scope, text)
    tagged = named.join(read, ["scope", "text"], "left").withColumn("number_key", F.array_join("numbers", ","))
    tagged = materialize(tagged.select("id", "scope", "form", "heads", "numbers", "number_key"), "names")
    with_form = tagged.filter(F.col("form").isNotNull())
    plain = with_form.groupBy("scope", "form").agg(F.first("heads").alias("heads"))
    forms = materialize(weigh(plain, plain), "forms")
    close = candidates(forms, forms, gram_order(forms)).filter("form_a < form_b")
    alike = materialize(_score(close, forms, forms, nicknames).filter(F.col("score") >= LINK).select("scope", "form_a", "form_b", "score"), "alike")
    shared = with_form.select("scope", "form", F.explode("numbers").alias("number")).distinct()
    by_number = shared.groupBy("scope", "number").agg(F.min("form").alias("first")).join(shared, ["scope", "number"]).select("scope", F.col("first").alias("form_a"), F.col("form").alias("form_b"))
    links = alike.select("scope", "form_a", "form_b").unionByName(by_number)
    key = lambda c: F.concat_ws("\x1d", "scope", c)
    family = components(links.select(key("form_a").alias("a"), key("form_b").alias("b")), "names")
    # one node per spelling and its numbers: a spelling with two different numbers is two people of one name
    nodes = with_form.groupBy("scope", "form", "number_key").agg(F.first("numbers").alias("numbers"), F.count("*").alias("n"))
    placed = nodes.withColumn("id", key("form")).join(family, "id", "left").withColumn("family", F.coalesce("component", "id"))
    edges = alike.withColumn("id", key("form_a")).join(family, "id").select(F.col("component").alias("family"), "form_a", "form_b", "score")
    # whole families share a bucket, so that a task is worth its start
    buckets = max(1, min(100_000, forms.count() // BUCKET_FORMS), rows.sparkSession.sparkContext.defaultParallelism)
    bucket = F.pmod(F.xxhash64("family"), F.lit(buckets)).alias("bucket")
    solved = placed.select("scope", "form", "number_key", "numbers", "n", "family", bucket).groupBy("bucket").cogroup(edges.select("*", bucket).groupBy("bucket"))
    solved = materialize(solved.applyInPandas(_entities(nicknames), "scope string, form string, number_key string, root string"), "entities")
    whole = tagged.join(solved, ["scope", "form", "number_key"], "left")
    least = whole.filter(F.col("root").isNotNull()).groupBy("scope", "root").agg(F.min("id").alias("entity"))
    out = whole.join(least, ["scope", "root"], "left").select("id", "scope", "form", F.coalesce("entity", "id").alias("entity"))
    forms_out = solved.join(least, ["scope", "root"]).select("scope", "form", "entity").distinct().join(forms, ["scope", "form"])
    return out, forms_out.select("scope", "form", "heads", "weights", "entity")


def match(queries: DataFrame, registry: DataFrame, nicknames: dict[str, tuple[str, ...]] = N.NICKNAMES) -> DataFrame:
    """(scope, text, entity): the one entity of the registry that each typed text names.

    queries: spellings(); registry: (scope, form, heads, weights, entity). A text that fits several entities about as well,
    or contradicts a spelling of the entity it would fit, names none."""
    queries = materialize(queries, "queries")
    registry = materialize(registry, "registry")
    held = registry.dropDuplicates(["scope", "form"])
    plain = queries.groupBy("scope", "form").agg(F.first("heads").alias("heads"))
    pairs = candidates(plain, held, gram_order(held))
    scored = _score(pairs, weigh(plain, held), held, nicknames)
    # a registered spelling that says less than the typed one is a worse witness than one that says as much
    rank = lambda c: _rank(F.split(c, r"\|"))
    less = rank("form_b") < F.least(rank("form_a"), F.lit(2))
    scored = scored.withColumn("score", F.when((F.col("score") > 0) & less, F.col("score") - 0.06).otherwise(F.col("score")))
    named = scored.join(registry.select("scope", F.col("form").alias("form_b"), "entity"), ["scope", "form_b"])
    fits = named.groupBy("scope", F.col("form_a").alias("form"), "entity").agg(F.max("score").alias("score"), F.bool_or("against").alias("against")).filter((F.col("score") >= LINK) & ~F.col("against"))
    ranked = fits.groupBy("scope", "form").agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", "entity")))).alias("e"))
    clear = (F.size("e") == 1) | (F.col("e")[0]["score"] - F.try_element_at("e", F.lit(2))["score"] >= MARGIN)
    found = ranked.filter(clear).select("scope", "form", F.col("e")[0]["entity"].alias("entity"))
    return queries.join(found, ["scope", "form"]).select("scope", "text", "entity")


def _rank(form: Column) -> Column:
    """names.rank() of the parts of a form."""
    given = F.filter(F.split(form[2], " "), lambda g: g != "")
    full = F.length(given[0]) > 1
    person = F.when(F.size(given) == 0, 0).when(full & (F.size(given) > 1), 3).when(full | (F.size(given) > 1), 2).otherwise(1)
    return F.when(form[0] == "body", 3).otherwise(person)
