"""Word lists and rules as parameters: read from JSON files of a folder, or given in code."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class TagRule:
    """A tag and what it asks of an article: any of the texts, all of the others, sentiment, category, paywall."""

    tag: str
    any_text: tuple[str, ...] = ()
    all_text: tuple[str, ...] = ()
    sentiment: str | None = None
    category: str | None = None
    paywall: bool | None = None


@dataclass(frozen=True)
class Lexicon:
    """Everything the analysis of texts is told from outside."""

    required: tuple[str, ...] = ()
    people: tuple[str, ...] = ()
    productions: tuple[str, ...] = ()
    venues: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    exclude_title: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    intensifiers: tuple[str, ...] = ()
    negations: tuple[str, ...] = ()
    kinds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    tones: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: tuple[TagRule, ...] = ()
    synonyms: tuple[tuple[str, ...], ...] = ()
    weights: dict[str, int] = field(default_factory=dict)
    thresholds: tuple[int, int, int] = (80, 50, 30)

    @classmethod
    def from_folder(cls, folder: str) -> Lexicon:
        """From keywords.json, sentiment.json, tags.json, synonyms.json and tones.json (name to words); files that are missing leave their lists empty."""

        def read(name: str) -> dict:
            p = Path(folder, f"{name}.json")
            return json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}

        k, s, t, y, z = map(read, ("keywords", "sentiment", "tags", "synonyms", "tones"))
        of = lambda d, n: tuple(d.get(n, ()))
        rules = tuple(TagRule(r["tag"], of(r, "match_text"), of(r, "min_required"), r.get("if_sentiment"), r.get("if_category"), r.get("if_paywall")) for r in t.get("rules", ()))
        limits = k.get("thresholds", {})
        return cls(
            of(k, "required"), of(k, "people"), of(k, "productions"), of(k, "venues"), of(k, "theater_context"), of(k, "exclude_title"), of(s, "positive"), of(s, "negative"), of(s, "intensifiers"), of(s, "negations"),
            {n: of(s, f"{n}_indicators") for n in ("review", "interview", "announcement")}, {n: tuple(ws) for n, ws in z.items()}, rules, tuple(tuple(g) for g in y.get("groups", ())), dict(k.get("scoring_weights", {})),
            (limits.get("very_relevant", 80), limits.get("relevant", 50), limits.get("maybe_relevant", 30)),
        )


#: A small lexicon for tests and queries. All names and words were taken from the texts of the test tables, where they stand; a user brings their own (``from_folder``).
EXAMPLE = Lexicon(
    required=("Lindenhof-Bühnen", "Haus der Gezeiten", "Volksbühne Silberau", "Schauspiel Nordtor"), people=("Petra Sassermann", "Kilian Gründelfelder", "Leopold Tangowsteinsen", "Rüdiger Stürtelhof", "Barbara Martenhorst"),
    productions=("Nachtlicht", "Die Salzgräfin", "Der gläserne Fährmann", "Sieben Sorten Schnee", "Wolfsmilch"), venues=("Glassaal", "Depot Ost", "Kupferhalle", "Lesekeller"), context=("Regie", "Premiere", "Ensemble", "Bühnenbild", "Dramaturgie", "Inszenierung", "Spielzeit"),
    exclude_title=("Stellenanzeige",), positive=("gelungen", "virtuos", "packend", "leuchtend", "klug", "feinsinnig", "stimmig", "brillant", "kraftvoll"), negative=("zäh", "mühsam", "flach", "konfus", "blutleer", "überladen", "langatmig", "bemüht"), intensifiers=("sehr", "geradezu"), negations=("nicht", "kein", "keine", "nie"),
    kinds={"review": ("kritik", "premiere", "applaus", "inszenierung", "bravorufe"), "interview": ("interview", "im gespräch", "sagt", "wie kam es"), "announcement": ("vorverkauf", "spielplan", "karten kosten", "neu im spielplan")},
    tones={"critical": ("zäh", "mühsam", "konfus", "flach", "blutleer"), "enthusiastic": ("virtuos", "packend", "brillant", "leuchtend"), "neutral": ("bericht", "meldet", "mitteilte"), "cautious": ("manchmal", "nicht immer", "etwas")},
    rules=(TagRule("produktion:nachtlicht", ("Nachtlicht",)), TagRule("produktion:salzgraefin", ("Die Salzgräfin",), ("Haus der Gezeiten",)), TagRule("form:interview", ("Wie kam es",)), TagRule("tonalitaet:positiv", sentiment="positiv"), TagRule("relevanz:top", category="sehr_relevant"), TagRule("qualitaet:paywall", paywall=True)),
)
