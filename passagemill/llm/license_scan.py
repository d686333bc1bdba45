"""Licence notices by a positional index of their rarest words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.llm.rows import packed, unpacked

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PROBES = 4
AGREEING = 0.6
# A notice and a start as one number, so that repeated ones are found by hash; a start may lie before the text.
NOTICE = 2**40
SHIFT = 1000


@dataclass(frozen=True)
class Notice:
    """A notice's words; ``key`` is the phrase that must stand in full. ``base`` notices are phrases of their own."""

    label: str
    words: str
    key: str
    base: bool = False

    @property
    def key_at(self) -> int:
        words, key = self.words.split(), self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


# Phrases of the contract and the opening words of public licence notices.
NOTICES = (
    Notice("mit", "under the mit license", "under the mit license", True),
    Notice("apache-2", "apache license version 2", "apache license version 2", True),
    Notice("cc-by-nc", "cc by nc", "cc by nc", True),
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    Notice(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org",
        "you may not use this file except in compliance with the license",
    ),
    Notice(
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "creative commons attribution noncommercial",
    ),
    Notice(
        "gpl-3",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        "gnu general public license",
    ),
    Notice(
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    Notice(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "subject to the terms of the mozilla public license",
    ),
    Notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software",
    ),
    Notice(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software released into the public domain",
    ),
)


def words(text: Column) -> Column:
    """Runs of digits, letters and characters above ASCII, in lower case; empty for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def document_frequencies(texts: DataFrame, notices=NOTICES) -> dict[str, int]:
    """In how many texts each licence word stands. The result has one entry per word of the notices."""
    vocabulary = sorted({w for n in notices for w in n.words.split()})
    held = F.array_intersect(words(F.col("text")), F.array(*[F.lit(w) for w in vocabulary]))
    counted = texts.select(F.explode(held).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counted.collect()}


def probes(notice: Notice, frequencies: dict[str, int], most: int = PROBES) -> list[tuple[str, int]]:
    """Words of the notice's key phrase with the highest inverse document frequency, with their positions."""
    key = notice.key.split()
    places = {w: notice.key_at + i for i, w in reversed(list(enumerate(key)))}
    rarest = sorted(places, key=lambda w: (frequencies[w], w))[:most]
    return [(w, places[w]) for w in rarest]


def _index(notices, frequencies) -> tuple[Column, Column, list[str]]:
    """Postings (word, notice, position) and the notices, as arrays of structs."""
    postings, table, looked_up = [], [], set()
    for number, notice in enumerate(notices):
        chosen = probes(notice, frequencies)
        looked_up |= {w for w, _ in chosen}
        postings += [
            F.struct(F.lit(w).alias("word"), F.lit(number).alias("notice"), F.lit(at).alias("at")) for w, at in chosen
        ]
        table.append(
            F.struct(
                F.lit(notice.label).alias("label"),
                F.lit(notice.base).alias("base"),
                F.lit(notice.key_at).alias("key_at"),
                F.array(*[F.lit(w) for w in notice.key.split()]).alias("key"),
                F.array(*[F.struct(F.lit(w).alias("word"), F.lit(at).alias("at")) for w, at in chosen]).alias("probes"),
            )
        )
    return F.array(*postings), F.array(*table), sorted(looked_up)


def _places(tokens: Column, postings: Column, table: Column) -> Column:
    """Notices that may begin at a word: enough probes agree on the start, and whether the key phrase stands."""
    met = F.flatten(
        F.transform(
            tokens,
            lambda w, i: F.transform(
                F.filter(postings, lambda p: p["word"] == w),
                lambda p: p["notice"] * F.lit(NOTICE) + i - p["at"] + F.lit(SHIFT),
            ),
        )
    )

    def place(number: Column) -> Column:
        start = (number % F.lit(NOTICE) - F.lit(SHIFT)).cast("int")
        return F.struct(F.floor(number / F.lit(NOTICE)).cast("int").alias("notice"), start.alias("start"))

    def judged(place: Column) -> Column:
        notice = F.get(table, place["notice"])
        at = place["start"] + notice["key_at"]
        agreeing = F.size(F.filter(notice["probes"], lambda p: F.get(tokens, place["start"] + p["at"]) == p["word"]))
        stands = F.when(at >= 0, F.slice(tokens, at + 1, F.size(notice["key"])) == notice["key"]).otherwise(False)
        return F.struct(
            notice["label"].alias("label"),
            notice["base"].alias("base"),
            at.cast("bigint").alias("at"),
            (agreeing / F.size(notice["probes"])).alias("share"),
            stands.alias("stands"),
        )

    return F.filter(F.transform(F.transform(F.array_distinct(met), place), judged), lambda p: p["share"] >= AGREEING)


def scan_licenses(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """``docs`` with the licence notices of every whole text.

    Adds ``n_words``; ``n_base``, ``first_word`` and ``last_word`` of the base phrases' places (null
    without any); ``base_labels`` and ``labels`` (sorted, comma-joined, empty without any); ``score``,
    1.0 for a verified notice, half the share of agreeing words for a place that fails, else 0.0.

    Document frequencies of the licence words are counted over all texts. A text that holds none of
    the rarest words is left after one lookup; in the others their positions are joined with the
    notices' postings, starts on which enough words agree are kept, and the key phrase is verified
    there. Any place of a key phrase holds all of its probes, so none is missed. Null and empty texts
    have no words. Everything is narrow but the count of a few dozen words, so repeated rows get the same result;
    long texts are read whole, in time that grows faster than their length; an empty table stays empty; of columns named like the results the results stay.
    """
    wide = packed(docs)
    frequencies = document_frequencies(wide.select(F.col("row.text").alias("text")), notices)
    postings, table, looked_up = _index(notices, frequencies)
    none = F.array().cast("array<struct<label:string,base:boolean,at:bigint,share:double,stands:boolean>>")
    rare = F.array(*[F.lit(w) for w in looked_up])
    found = wide.withColumn("tokens", words(F.col("row.text"))).withColumn(
        "places",
        tx.let(F.col("tokens"), lambda t: F.when(F.arrays_overlap(t, rare), _places(t, postings, table)).otherwise(none)),
    )
    verified = F.filter("places", lambda p: p["stands"])
    base = F.filter(verified, lambda p: p["base"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    score = F.array_max(F.transform("places", lambda p: F.when(p["stands"], 1.0).otherwise(p["share"] / 2)))
    starts = F.transform(base, lambda p: p["at"])
    added = {
        "n_words": F.size("tokens").cast("bigint"),
        "n_base": F.size(base).cast("bigint"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": labels(base),
        "labels": labels(verified),
        "score": F.coalesce(score, F.lit(0.0)),
    }
    out = found.select("row", *[value.alias(name) for name, value in added.items()])
    return out.select(*unpacked(docs.columns, list(added)))
