"""Post-processing of generated-token streams.

Responses are either arrays of token strings (one row per response; the
cheapest form, no shuffle) or token rows ``(response keys..., pos, token)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize
from ..session import unique_subdir
from ..sources.tables import spread
from .prefix import join_null_safe, running_sum


#: Leading characters by which a stop is looked up in a reply.
ANCHOR = 8


def response_tokens(conv: DataFrame) -> DataFrame:
    """Assistant turns as token arrays: ``conv_id, turn, tokens``."""
    replies = spread(conv.filter(F.col("role") == "assistant").select("conv_id", "turn", "text"))
    return replies.select("conv_id", "turn", tokenize(F.col("text")).alias("tokens"))


def response_token_rows(conv: DataFrame) -> DataFrame:
    """Assistant turns as token rows: ``conv_id, turn, pos, token``."""
    return conv.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode_outer(tokenize(F.col("text"))).alias("pos", "token")) \
        .filter(F.col("token").isNotNull())


def responses(conv: DataFrame) -> DataFrame:
    """The keys of all assistant turns, those without tokens included."""
    return conv.filter(F.col("role") == "assistant").select("conv_id", "turn")


def _stop_step(k: Column, tok: Column, stop: str | Column) -> tuple[Column, Column]:
    """One step of token-aligned stop matching for one stop string (or a column of them).

    ``k`` = characters of ``stop`` matched so far. Returns (completed, new k).
    A match starts only at a token boundary; partial progress carries across
    tokens; on a mismatch with progress the same token is retried from 0
    (no fallback inside the stop string)."""
    if isinstance(stop, str):
        if not stop:
            return F.lit(True), k
        s, L = F.lit(stop), F.lit(len(stop))
    else:
        s, L = stop, F.length(stop)
    tl = F.length(tok)

    def from_state(kk: Column) -> tuple[Column, Column, Column]:
        rem = F.substring(s, kk + 1, L)
        rl = L - kk
        done = (tl >= rl) & F.startswith(tok, rem)
        partial = (tl < rl) & F.startswith(rem, tok)
        return done, partial, kk + tl

    done_k, partial_k, adv_k = from_state(k)
    done_0, partial_0, adv_0 = from_state(F.lit(0))
    completed = done_k | (~partial_k & (k != 0) & done_0)
    new_k = (F.when(done_k, F.lit(0))
             .when(partial_k, adv_k)
             .when((k != 0) & partial_0, adv_0)
             .otherwise(F.lit(0)))
    return completed, new_k


def stop_advance(matched: int, token: bytes, stop: bytes) -> tuple[bool, int]:
    """:func:`_stop_step` for one row at a time (the live stream): whether ``token``
    completes ``stop``, and how much of it is matched after. What follows a
    completion is not tracked: the response ends there."""
    for start in dict.fromkeys((matched, 0)):
        rest = stop[start:]
        if token.startswith(rest):
            return True, len(stop)
        if rest.startswith(token):
            return False, start + len(token)
    return False, 0


def stop_position(tokens: Column | str, stops: Sequence[str]) -> Column:
    """1-based position of the first token that completes any stop sequence,
    or NULL. Folded natively over the token array (no UDF)."""
    tk = F.col(tokens) if isinstance(tokens, str) else tokens
    if not stops:
        return F.lit(None).cast("int")
    names = [f"k{i}" for i in range(len(stops))]
    init = F.struct(F.lit(0).alias("i"), F.lit(None).cast("int").alias("hit"),
                    *[F.lit(0).alias(n) for n in names])

    def merge(acc: Column, tok: Column) -> Column:
        i = acc["i"] + 1
        parts, any_done = [], F.lit(False)
        for n, stop in zip(names, stops):
            done, nk = _stop_step(acc[n], tok, stop)
            any_done = any_done | done
            parts.append(nk.alias(n))
        hit = F.when(acc["hit"].isNull() & any_done, i).otherwise(acc["hit"])
        return F.struct(i.alias("i"), hit.alias("hit"), *parts)

    fold = F.aggregate(tk, init, merge, lambda acc: acc["hit"])
    # A token-aligned match spells the stop string inside the response text, so
    # responses containing none of them skip the fold.
    text = F.array_join(tk, "")
    maybe = F.lit(False)
    for stop in stops:
        maybe = maybe | F.contains(text, F.lit(stop))
    return F.when(maybe, fold).otherwise(F.lit(None).cast("int"))


def stop_tokens(responses: DataFrame, stops: Sequence[str], tokens_col: str = "tokens") -> DataFrame:
    """Cut each response before the token completing a stop sequence (that
    token is not emitted; earlier tokens of a partial match were)."""
    pos = stop_position(tokens_col, stops)
    tk = F.col(tokens_col)
    kept = F.when(pos.isNull(), tk).otherwise(F.slice(tk, 1, pos - 1))
    return responses.withColumn("stop_at", pos).withColumn(tokens_col, kept)


def stop_match(tokens: Column | str, stops: Column | str) -> Column:
    """``struct<at, stop>``: :func:`stop_position` for a column ``stops`` of stop strings,
    and the first (in string order) of those that the token completes.

    One fold whatever the number of stops: its state is an array, a member for each stop
    that the response's text contains (a match spells the stop inside the text)."""
    tk = F.col(tokens) if isinstance(tokens, str) else tokens
    sets = F.col(stops) if isinstance(stops, str) else stops
    present = F.filter(sets, lambda s: F.contains(F.array_join(tk, ""), s))
    states = F.transform(present, lambda s: F.struct(s.alias("s"), F.lit(0).alias("k"), F.lit(False).alias("done")))
    init = F.struct(F.lit(0).alias("i"), states.alias("states"))

    def completed(acc: Column) -> Column:
        return F.exists(acc["states"], lambda x: x["done"])

    def advance(x: Column, tok: Column) -> Column:
        done, k = _stop_step(x["k"], tok, x["s"])
        return F.struct(x["s"].alias("s"), k.alias("k"), F.coalesce(done, F.lit(False)).alias("done"))

    def merge(acc: Column, tok: Column) -> Column:
        # the states stay as they are once a stop is complete
        return F.when(completed(acc), acc).otherwise(F.struct(
            (acc["i"] + 1).alias("i"), F.transform(acc["states"], lambda x: advance(x, tok)).alias("states")))

    def finish(acc: Column) -> Column:
        first = F.array_min(F.transform(F.filter(acc["states"], lambda x: x["done"]), lambda x: x["s"]))
        return F.when(completed(acc), F.struct(acc["i"].alias("at"), first.alias("stop")))

    return F.aggregate(tk, init, merge, finish)


def stop_tokens_by_task(responses: DataFrame, stops: DataFrame, task: str = "task", stop: str = "stop",
                        tokens_col: str = "tokens") -> DataFrame:
    """:func:`stop_tokens` with the stop strings of each response's task, from a table
    (``task``, ``stop``). Adds ``stop_at`` and ``stopped_by``.

    A reply is only matched with stops that begin like the text at one of its token
    boundaries: the first :data:`ANCHOR` characters there meet those of the task's stops in
    an equi-join, so work follows the replies and what they may hold, not all stops of a task.
    Repeated and null stops count once and not at all, an empty stop ends a response at
    its first token; a null task is a task; responses of a task without stops stay whole.
    """
    spark = responses.sparkSession
    path = unique_subdir(spark, "stops")  # numbered once, so that a reply finds its own stops again
    responses.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*responses.schema.fields, T.StructField("__row", T.LongType())])).parquet(path)
    sets = stops.where(F.col(stop).isNotNull()).select(F.col(task).alias(task), F.col(stop).alias("__stop")).distinct()
    sets = sets.withColumn("__anchor", F.substring("__stop", 1, ANCHOR))
    # at most ANCHOR + 1 numbers
    lengths = sorted(r.n for r in sets.select(F.length("__anchor").alias("n")).distinct().collect())
    sizes = F.array(*[F.lit(n) for n in lengths if n]) if any(lengths) else F.array().cast("array<int>")
    # a column of its own: inside the transform it would be made again for every token
    filled = rows.select("__row", F.col(task).alias(task), F.size(tokens_col).alias("__n"),
                         F.filter(tokens_col, lambda t: F.length(t) > 0).alias("__full"))
    full = F.col("__full")
    starts = F.array_distinct(F.transform(full, lambda t, i: F.substring(F.array_join(F.slice(full, i + 1, ANCHOR), ""), 1, ANCHOR)))
    pieces = F.flatten(F.transform(starts, lambda w: F.transform(
        F.filter(sizes, lambda n: n <= F.length(w)), lambda n: w.substr(F.lit(1), n))))
    empty = F.when(F.col("__n") > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    asked = filled.select("__row", task, F.explode(F.array_distinct(F.concat(pieces, empty))).alias("__anchor"))
    met = join_null_safe(asked, sets, [task, "__anchor"]).groupBy("__row").agg(F.collect_set("__stop").alias("__stops"))
    with_stops = rows.join(met, "__row", "left").select(*responses.columns, "__stops")
    hit = with_stops.withColumn("__hit", stop_match(tokens_col, "__stops"))
    tk, at = F.col(tokens_col), F.col("__hit.at")
    return (hit.withColumn("stop_at", at).withColumn("stopped_by", F.col("__hit.stop"))
            .withColumn(tokens_col, F.when(at.isNull(), tk).otherwise(F.slice(tk, 1, at - 1))).drop("__stops", "__hit"))


def postprocess(responses: DataFrame, stops: Sequence[str] = (), max_tokens: int | None = None,
                eot: str | None = None, private_tokens: Sequence[str] = (),
                tokens_col: str = "tokens") -> DataFrame:
    """All generation stop rules in their order per token: end-of-text (not
    emitted), stop sequence completed (not emitted), private token (swallowed
    but counted), max tokens (inclusive). One native expression per row."""
    tk = F.col(tokens_col)
    n = F.size(tk)
    end = n  # number of leading tokens that survive the cut
    if eot is not None:
        p = F.array_position(tk, F.lit(eot)).cast("int")
        end = F.when(p > 0, p - 1).otherwise(end)
    if stops:
        sp = stop_position(tk, stops)
        end = F.when(sp.isNotNull(), F.least(end, sp - 1)).otherwise(end)
    if max_tokens is not None:
        end = F.least(end, F.lit(max_tokens))
    kept = F.slice(tk, 1, end)
    if private_tokens:
        priv = F.array(*[F.lit(t) for t in private_tokens])
        kept = F.filter(kept, lambda t: ~F.array_contains(priv, t))
    return responses.withColumn(tokens_col, kept)


def stop_text(df: DataFrame, stops: Sequence[str], text_col: str = "text") -> DataFrame:
    """Text mode: cut at the earliest occurrence of any stop string."""
    t = F.col(text_col)
    if not stops:
        return df.withColumn("stop_at", F.lit(None).cast("long"))
    found = [F.nullif(F.locate(s, t), F.lit(0)) for s in stops]
    first = F.least(*found) if len(found) > 1 else found[0]
    cut = F.when(first.isNull(), t).otherwise(F.substring(t, F.lit(1), first - 1))
    return df.withColumn("stop_at", first.cast("long")).withColumn(text_col, cut)


def max_tokens(responses: DataFrame, n: int, tokens_col: str = "tokens") -> DataFrame:
    """Keep at most ``n`` generated tokens per response."""
    return responses.withColumn(tokens_col, F.slice(F.col(tokens_col), 1, n))


def eot_cut(responses: DataFrame, eot: str, tokens_col: str = "tokens") -> DataFrame:
    """Stop at the end-of-text token (not emitted)."""
    tk = F.col(tokens_col)
    p = F.array_position(tk, F.lit(eot))
    return responses.withColumn(tokens_col, F.when(p == 0, tk).otherwise(F.slice(tk, 1, (p - 1).cast("int"))))


def swallow_private(responses: DataFrame, private_tokens: Sequence[str], tokens_col: str = "tokens") -> DataFrame:
    """Drop output pieces exactly equal to a private token."""
    if not private_tokens:
        return responses
    priv = F.array(*[F.lit(t) for t in private_tokens])
    return responses.withColumn(tokens_col, F.filter(F.col(tokens_col), lambda t: ~F.array_contains(priv, t)))


def response_text(token_rows: DataFrame, keys: Sequence[str] = ("conv_id", "turn"),
                  all_responses: DataFrame | None = None) -> DataFrame:
    """Concatenate token rows in position order into the response text. Given
    ``all_responses`` (the keys), a response without rows gets an empty text."""
    texts = token_rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))),
                                 lambda s: s["token"]), "").alias("text"))
    if all_responses is None:
        return texts
    return join_null_safe(all_responses.select(*keys), texts, list(keys), "left").withColumn(
        "text", F.coalesce("text", F.lit("")))


def byte_pieces(texts: DataFrame, keys: Sequence[str], size: int, text_col: str = "text") -> DataFrame:
    """Generated bytes as they arrive from a byte-level tokenizer: each text's
    UTF-8 bytes cut into ``size``-byte pieces (pieces may split a character).
    Output ``keys..., pos, piece (binary)``."""
    b = F.encode(F.col(text_col), "UTF-8")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(b), F.lit(1)), F.lit(size)),
                         lambda i: F.substring(b, i, size))
    return (texts.select(*keys, F.posexplode_outer(pieces).alias("pos", "piece"))
            .filter(F.col("piece").isNotNull()))


def reassemble_utf8(pieces: DataFrame, keys: Sequence[str] = ("conv_id", "turn"), piece_col: str = "piece") -> DataFrame:
    """Concatenate byte pieces in order per response and decode; invalid
    sequences become U+FFFD (lossy, like a lossy UTF-8 decode)."""
    hexes = F.transform(F.array_sort(F.collect_list(F.struct("pos", piece_col))), lambda s: F.hex(s[piece_col]))
    raw = F.unhex(F.array_join(hexes, ""))
    return pieces.groupBy(*keys).agg(F.make_valid_utf8(raw.cast("string")).alias("text"))


def cycle_segments(stream: DataFrame, key: str = "conv_id") -> DataFrame:
    """Split a token stream ``(key, pos, token)`` into messages: an empty token
    ends a reply. Adds ``msg_no`` = number of empty tokens strictly before
    (a block-wise running count, see ``operators.prefix``)."""
    ends = F.when(F.col("token") == "", 1).otherwise(0).cast("long")
    out = running_sum(stream.withColumn("__end", ends), [key], "pos", "__end", "__cum")
    return out.withColumn("msg_no", (F.col("__cum") - F.col("__end")).cast("long")).drop("__end", "__cum")


def reply_stream(conv: DataFrame) -> DataFrame:
    """A session's generated-token stream: the assistant replies in turn order,
    each followed by the empty end-of-cycle token. ``conv_id, turn, pos, token``
    where ``pos`` orders tokens within the session (turn-major)."""
    tk = F.concat(tokenize(F.col("text")), F.array(F.lit("")))
    rows = conv.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode(tk).alias("p", "token"))
    return rows.select("conv_id", "turn", (F.col("turn") * F.lit(1 << 32) + F.col("p")).alias("pos"), "token")
