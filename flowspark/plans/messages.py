"""Passenger messages in three languages and three channels, as a join with a template table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.time import hhmm

REASONS = [
    ("safety inspection", "for a safety check", "wegen einer Sicherheitsprüfung", "pour un contrôle de sécurité"),
    ("switch replacement", "for work on the switches", "wegen Arbeiten an den Weichen", "pour des travaux d'aiguillage"),
    ("track maintenance", "for work on the track", "wegen Gleisarbeiten", "pour des travaux sur la voie"),
    ("power system maintenance", "for work on the power supply", "wegen Arbeiten am Stromnetz", "pour des travaux électriques"),
    ("signal failure", "after a signal fault", "nach einer Signalstörung", "après une panne de signal"),
    ("track works", "for work on the track", "wegen Gleisarbeiten", "pour des travaux sur la voie"),
    ("escalator works", "for work on an escalator", "wegen Arbeiten an einer Rolltreppe", "pour des travaux sur un escalier mécanique"),
    ("police operation", "for a police operation", "wegen eines Polizeieinsatzes", "pour une intervention de la police"),
    ("technical fault", "after a technical fault", "nach einer technischen Störung", "après un incident technique"),
    ("", "for operational reasons", "aus betrieblichen Gründen", "pour des raisons d'exploitation"),
]
TEMPLATES = [
    ("station", "en", "announcement", "{a} is closed {reason} until {until}. Trains pass without stopping. Please use {alt}."),
    ("station", "de", "announcement", "{a} ist {reason} bis {until} Uhr geschlossen. Die Züge halten nicht. Bitte nutzen Sie {alt}."),
    ("station", "fr", "announcement", "{a} est fermée {reason} jusqu'à {until}. Les trains passent sans arrêt. Merci d'utiliser {alt}."),
    ("station", "en", "display", "{a}: closed until {until}"),
    ("station", "de", "display", "{a}: geschlossen bis {until} Uhr"),
    ("station", "fr", "display", "{a} : fermée jusqu'à {until}"),
    ("station", "en", "app", "{a} stays closed {reason} until about {until}. Other ways: {alt}."),
    ("station", "de", "app", "{a} bleibt {reason} bis etwa {until} Uhr geschlossen. Andere Wege: {alt}."),
    ("station", "fr", "app", "{a} reste fermée {reason} jusque vers {until}. Autres possibilités : {alt}."),
    ("line", "en", "app", "No {line} trains from {a} to {b} {reason} until about {until}; they run on the rest of the line. Other ways: {alt}."),
    ("line", "de", "app", "Keine {line} zwischen {a} und {b} {reason} bis etwa {until} Uhr; auf der übrigen Strecke fährt sie. Andere Wege: {alt}."),
    ("line", "fr", "app", "Pas de {line} de {a} à {b} {reason} jusque vers {until} ; elle circule sur le reste de la ligne. Autres possibilités : {alt}."),
    ("event", "en", "app", "Crowds are expected around {until}. Other ways: {alt}."),
    ("event", "de", "app", "Gegen {until} Uhr wird es voll. Andere Wege: {alt}."),
    ("event", "fr", "app", "Affluence vers {until}. Autres possibilités : {alt}."),
    ("event", "en", "display", "Crowds around {until}: use {alt}"),
    ("event", "de", "display", "Andrang gegen {until} Uhr: {alt} nutzen"),
    ("event", "fr", "display", "Affluence vers {until} : prenez {alt}"),
    ("line", "en", "announcement", "{line} does not run from {a} to {b} {reason} until {until}. Please use {alt}."),
    ("line", "de", "announcement", "{line} fährt zwischen {a} und {b} {reason} bis {until} Uhr nicht. Bitte nutzen Sie {alt}."),
    ("line", "fr", "announcement", "{line} ne circule pas de {a} à {b} {reason} jusqu'à {until}. Merci d'utiliser {alt}."),
    ("line", "en", "display", "{line} {a} - {b}: no trains until {until}"),
    ("line", "de", "display", "{line} {a} - {b}: kein Verkehr bis {until} Uhr"),
    ("line", "fr", "display", "{line} {a} - {b} : pas de trains jusqu'à {until}"),
    ("event", "en", "announcement", "Many visitors are expected around {until}. Please spread along the platform and consider {alt}."),
    ("event", "de", "announcement", "Gegen {until} Uhr werden viele Besucher erwartet. Bitte verteilen Sie sich am Bahnsteig oder nutzen Sie {alt}."),
    ("event", "fr", "announcement", "Forte affluence attendue vers {until}. Répartissez-vous sur le quai ou utilisez {alt}."),
]
NO_ALT = {"en": "other lines", "de": "andere Linien", "fr": "d'autres lignes"}
OR = {"en": " or ", "de": " oder ", "fr": " ou "}


def passenger_messages(items: DataFrame, spark: SparkSession) -> DataFrame:
    """Messages for (item_id, kind, description, line, a, b, until, alternatives ARRAY).

    One row per item, language and channel.
    """
    tpl = spark.createDataFrame(TEMPLATES, "kind string, lang string, channel string, template string")
    j = items.join(tpl, "kind")
    desc = F.lower(F.coalesce("description", F.lit("")))
    by_lang = {}
    for i, lang in enumerate(("en", "de", "fr")):
        out = F.lit(REASONS[-1][i + 1])
        for r in reversed(REASONS[:-1]):
            out = F.when(desc.contains(r[0]), F.lit(r[i + 1])).otherwise(out)
        by_lang[lang] = out
    pick = lambda m: F.coalesce(*[F.when(F.col("lang") == k, v if not isinstance(v, str) else F.lit(v)) for k, v in m.items()])
    alts = F.coalesce("alternatives", F.array().cast("array<string>"))
    alt = F.when(F.size(alts) == 0, pick(NO_ALT)).otherwise(F.array_join(alts, "\u0001"))
    alt = F.replace(alt, F.lit("\u0001"), pick(OR))
    text = F.col("template")
    for k, v in {"{a}": F.col("a"), "{b}": F.col("b"), "{line}": F.col("line"), "{until}": hhmm("until"), "{reason}": pick(by_lang), "{alt}": alt}.items():
        text = F.replace(text, F.lit(k), F.coalesce(v, F.lit("")))
    return j.select("item_id", "kind", "lang", "channel", F.regexp_replace(text, r"\.\.(?=\s|$)", ".").alias("message"))
