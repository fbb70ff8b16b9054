"""The three-level label ontology and the tables that look names up in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ontology. Names of one level under the name above, in the order that options are listed.
FIRST = "person, location, product, facility, art, group, miscellaneous, science entity"
SECOND = {
    "person": "real person, fictional figure",
    "location": "geographical entity, geo-political entity, address",
    "product": "food, weapon, technology, vehicle, other product",
    "facility": "public facility, commercial facility, transportation facility, production facility, other facility",
    "art": "visual art, music, literature, other art",
    "group": "social group, non-commercial organization, commercial organization",
    "miscellaneous": "award, event, miscellaneous",
    "science entity": "biological, chemical, physical, computer science, medical, other scientific entity",
}
THIRD = {
    "real person": "politician, artist, author, athlete, director, actor, scholar, military, musician, business executive, other person",
    "fictional figure": "mythological figure, other figure",
    "geographical entity": "water body, mountain, island, desert, other geographical entity",
    "geo-political entity": "continent, country, state or province, city, district, region, other gpe",
    "address": "address, road, railway, other address",
    "food": "beverages, packaged foods, other food",
    "weapon": "firearms, biological, chemical weapon, explosives, cold weapon, nuclear, other weapon",
    "technology": "software, website, electronics, ai, other technology",
    "vehicle": "air, car, water, rail, bike, other vehicle",
    "other product": "clothes, household, personal care, toys, musical instruments, other product",
    "public facility": "hospital, library, park, landmark, school, museum, sports facility, other public facility",
    "commercial facility": "hotel, restaurant, market/mall, theater/cinema, bank, other commercial facility",
    "transportation facility": "airport, station, port, other transportation facility",
    "production facility": "factory, farm, mine, energy, other production facility",
    "other facility": "residential, government facility, other facility",
    "visual art": "painting, sculpture, visual art genre, other visual art",
    "music": "song, album, music genre, other music",
    "literature": "poem, non-fiction, fiction, literature genre, other literature",
    "other art": "film, play, broadcast program, game, other art",
    "social group": "ethnic group, religious group, other social group",
    "non-commercial organization": "educational and research, political/military, community, religious organization, other non-commercial organization",
    "commercial organization": "sports team/league, band, company, media, other commercial organization",
    "award": "literary award, sports award, artistic award, other award",
    "event": "political/military event, sporting event, disaster, business event, other event",
    "miscellaneous": "educational degree, tradition, god, law, language, miscellaneous",
    "biological": "protein, species, biological theory, other biological entity",
    "chemical": "element, compound, reaction, chemical theory, other chemical entity",
    "physical": "physical phenomenon, astronomical object, physical theory, other physical entity",
    "computer science": "programlang, algorithm, other computer science entity",
    "medical": "disease, injury, medication, symptom, medical theory, other medical entity",
    "other scientific entity": "discipline, academic journal, conference, metrics, other scientific entity",
}

# A synonym for each name, as lines of a synonym file (name---synonym).
SYNONYM_LINES = """
academic journal---scholarly journal
actor---thespian
address---street address
ai---artificial intelligence
air---atmosphere
airport---aerodrome
album---record album
algorithm---computational procedure
art---artwork
artist---artistic creator
artistic award---arts accolade
astronomical object---celestial body
athlete---sportsperson
author---writer
award---accolade
band---musical group
bank---financial institution
beverages---drinks
bike---bicycle
biological---biological entity
biological theory---theory of biology
broadcast program---broadcast show
business event---corporate event
business executive---corporate executive
car---automobile
chemical---chemical substance
chemical theory---chemical concept
chemical weapon---chemical agent
city---municipality
clothes---clothing
cold weapon---melee weapon
commercial facility---commercial premises
commercial organization---commercial entity
community---social group
company---firm
compound---chemical compound
computer science---computing
conference---symposium
continent---continental landmass
country---sovereign state
desert---arid region
director---filmmaker
disaster---catastrophe
discipline---academic field
disease---illness
district---administrative division
educational and research---academic and research
educational degree---academic degree
electronics---electronic devices
element---chemical element
energy---power
ethnic group---ethnicity
event---occurrence
explosives---explosive material
facility---installation
factory---manufacturing plant
farm---agricultural estate
fiction---fictional work
fictional figure---fictional character
film---movie
firearms---small arms
food---foodstuff
game---pastime
geo-political entity---geopolitical unit
geographical entity---geographic feature
god---deity
government facility---state facility
group---collective
hospital---medical center
hotel---lodging establishment
household---domestic unit
injury---physical wound
island---isle
landmark---point of interest
language---tongue
law---legislation
library---book repository
literary award---literary prize
literature---written works
literature genre---literary genre
location---place
market/mall---shopping center
media---mass media
medical---healthcare
medical theory---medical doctrine
medication---pharmaceutical
metrics---measurements
military---armed forces
mine---mining site
miscellaneous---uncategorized
mountain---peak
museum---exhibition venue
music---musical works
music genre---musical style
musical instruments---music instruments
musician---musical artist
mythological figure---mythological character
non-commercial organization---nonprofit organization
non-fiction---factual writing
nuclear---atomic
other address---unspecified address
other art---miscellaneous art
other award---additional award
other biological entity---unspecified biological entity
other chemical entity---miscellaneous chemical entity
other commercial facility---unspecified commercial facility
other commercial organization---miscellaneous commercial organization
other computer science entity---unspecified computer science entity
other event---miscellaneous event
other facility---unspecified facility
other figure---miscellaneous figure
other food---miscellaneous food
other geographical entity---unspecified geographical entity
other gpe---miscellaneous gpe
other literature---miscellaneous literature
other medical entity---unspecified medical entity
other music---miscellaneous music
other non-commercial organization---unspecified non-commercial organization
other person---unspecified person
other physical entity---miscellaneous physical entity
other product---miscellaneous product
other production facility---unspecified production facility
other public facility---unspecified public facility
other scientific entity---miscellaneous scientific entity
other social group---unspecified social group
other technology---unspecified technology
other transportation facility---unspecified transit facility
other vehicle---unspecified vehicle
other visual art---unspecified visual art
other weapon---unspecified weapon
packaged foods---prepackaged food
painting---painted artwork
park---public park
person---individual
personal care---personal hygiene product
physical---physical entity
physical phenomenon---natural phenomenon
physical theory---physics theory
play---theatrical play
poem---poetic work
political/military---politico-military
political/military event---politico-military event
politician---political figure
port---seaport
product---merchandise
production facility---manufacturing facility
programlang---programming language
protein---polypeptide
public facility---civic facility
rail---railway
railway---railroad
reaction---chemical reaction
real person---actual person
region---geographical region
religious group---faith group
religious organization---faith organization
residential---residential area
restaurant---eatery
road---roadway
scholar---academic
school---educational institution
science entity---scientific entity
sculpture---sculptural work
social group---social collective
software---computer program
song---musical track
species---biological species
sporting event---sports event
sports award---athletic award
sports facility---sports venue
sports team/league---athletic team/league
state or province---province or state
station---transit station
symptom---medical symptom
technology---technological entity
theater/cinema---cinema venue
toys---playthings
tradition---custom
transportation facility---transit facility
vehicle---conveyance
visual art---artwork
visual art genre---art style
water---water feature
water body---body of water
weapon---armament
website---internet site
""".strip()


def names(listed: str | list, delimiter: str = ", ") -> list[str]:
    """Names of a list written with a delimiter; a bare comma also strips and drops empty names. A list stays one."""
    if isinstance(listed, list):
        return [str(x).strip() for x in listed if str(x).strip()]
    return listed.split(delimiter) if delimiter != "," else [x.strip() for x in listed.split(",") if x.strip()]


@dataclass(frozen=True)
class Taxonomy:
    """Lookups over an ontology of a few hundred names; each becomes a local table that Spark broadcasts.

    One name can stand at several levels, so there is no one parent of a name: every lookup states which
    of its places counts. Edges are numbered as a walk meets them, and the last place of a name wins.
    """

    first: tuple[str, ...]
    second: dict[str, list[str]]
    third: dict[str, list[str]]

    @classmethod
    def of(cls, first=FIRST, second=SECOND, third=THIRD, delimiter: str = ", ") -> Taxonomy:
        return cls(tuple(names(first, delimiter)), {k: names(v, delimiter) for k, v in second.items()}, {k: names(v, delimiter) for k, v in third.items()})

    @classmethod
    def nested(cls, tree: dict[str, dict[str, list[str]]]) -> Taxonomy:
        """From nested objects: first level, second level, list of third-level names."""
        return cls(tuple(tree), {k: list(v) for k, v in tree.items()}, {s: list(t) for v in tree.values() for s, t in v.items()})

    def edges(self) -> list[tuple[int, str, str]]:
        """(level, parent, name): each second-level name is followed by its own third-level names."""
        return [e for f, ss in self.second.items() for s in ss for e in [(2, f, s), *((3, s, t) for t in self.third.get(s, []))]]

    def parent(self) -> dict[str, str]:
        """The parent at the last place of a name; first-level names have none and stand for themselves."""
        return {n: p for _, p, n in self.edges()}

    def children(self) -> dict[str, list[str]]:
        """A name's children; for a name of both upper levels those of the third level."""
        return {**self.second, **self.third}

    def branch(self) -> dict[str, str]:
        return {n: f"L{level - 1}::{p}" for level, p, n in self.edges()}

    def leaf_parent(self) -> dict[str, str]:
        return {t: s for s, ts in self.third.items() for t in ts}

    def all_names(self) -> list[str]:
        return sorted({*self.first, *(n for _, _, n in self.edges())})

    def siblings(self, name: str) -> list[str]:
        above = self.parent().get(name, name)
        return list(self.first) if above == name else self.children().get(above, [])

    def related(self, name: str) -> list[str]:
        """Siblings (itself included), parent and children."""
        above = self.parent().get(name, name)
        return sorted({*self.siblings(name), *self.children().get(name, []), *([above] if above != name else [])})

    def path(self, name: str, default: str = "miscellaneous") -> tuple[str, str, str]:
        """(first, second, third): the name as a leaf, else one level up, else at the top, else the default."""
        above = {s: f for f, ss in reversed(self.second.items()) for s in ss}
        leaf = {t: s for s, ts in reversed(self.third.items()) for t in ts}
        if name in leaf:
            return above[leaf[name]], leaf[name], name
        if name in above:
            return above[name], name, name
        return (name,) * 3 if name in self.first else (default,) * 3

    def options(self, level: int, name: str) -> list[str]:
        """The list that a name of a level is chosen from; none at the third level for a name that is no leaf."""
        if level == 1:
            return list(self.first)
        lists = self.second if level == 2 else self.third
        found = next((v for v in lists.values() if name in v), None)
        return found if found is not None else (self.second.get(name, []) if level == 2 else [])

    # tables

    def parent_table(self, spark: SparkSession) -> DataFrame:
        p = self.parent()
        return spark.createDataFrame([(n, p.get(n, n)) for n in self.all_names()], "category string, parent string")

    def branch_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.branch().items()), "category string, branch string")

    def leaf_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.leaf_parent().items()), "category string, parent string")

    def children_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.children().items()), "category string, children array<string>")

    def related_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, self.related(n)) for n in self.all_names()], "category string, related array<string>")

    def path_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, *self.path(n)) for n in self.all_names()], "category string, l1 string, l2 string, l3 string")

    def options_table(self, spark: SparkSession) -> DataFrame:
        rows = [(level, n, self.options(level, n)) for level in (1, 2, 3) for n in self.all_names()]
        return spark.createDataFrame(rows, "level int, category string, options array<string>")

    def leaf_index(self, spark: SparkSession) -> DataFrame:
        """(i, l3, l2, l1): leaves numbered in code point order."""
        return spark.createDataFrame([(i, t, *self.path(t)[1::-1]) for i, t in enumerate(sorted(self.leaf_parent()))], "i int, l3 string, l2 string, l1 string")

    def choices_table(self, spark: SparkSession) -> DataFrame:
        """(level, parent_key, answer_key, option, next_options): what a classifier may answer, keyed in lower case."""
        rows = [(1, "", o.lower(), o) for o in self.first]
        rows += [(2, p.lower(), o.lower(), o) for p, os in self.second.items() for o in os]
        rows += [(3, p.lower(), o.lower(), o) for p, os in self.third.items() for o in os]
        return spark.createDataFrame(rows, "level int, parent_key string, answer_key string, option string")


def lookup(table: dict[str, str], key: Column) -> Column:
    """A dictionary of a fixed vocabulary as a map literal; null for names that it lacks."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def synonyms(lines: DataFrame, separator: str = "---") -> DataFrame:
    """(category, synonym) from lines (line_no, value) of two parts; the last line of a name counts. Names are lower-cased."""
    parts = F.split("value", separator.replace("|", r"\|"))
    good = lines.withColumn("p", parts).where(F.size("p") == 2)
    return good.select(F.lower(F.trim(F.col("p")[0])).alias("category"), F.trim(F.col("p")[1]).alias("synonym"), "line_no").groupBy("category").agg(F.max_by("synonym", "line_no").alias("synonym"))


def synonym_map(text: str = SYNONYM_LINES, separator: str = "---") -> dict[str, str]:
    pairs = [x.split(separator) for x in text.splitlines()]
    return {p[0].strip().lower(): p[1].strip() for p in pairs if len(p) == 2}
