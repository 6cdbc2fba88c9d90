"""A regression table of route lengths, and its check against a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.graph import Graph
from .operators.paths import route_batch

# Pairs of English Wikipedia titles and the pages on a shortest route, both
# ends included, 0 for no route.  They hold for a dump of unstated date.
PAIRS = [
    ("Pepe Ozan", "Kryponite", 0),
    ("Phœbus", "Olga Alexandrova", 7),
    ("Niccolo Berrettoni", "Ἐπίδαυρος", 0),
    ("Adlivun", "Danutė Kvietkevičiūtė", 8),
    ("Harbour Le Cou, Newfoundland and Labrador", "Thorsten Marschner", 0),
    ("At the gate of horn", "Sunga (disambiguation)", 0),
    ("Felix Francois Faure", "Kenwood (disambiguation)", 10),
    ("Jean-Paul Fournier", "Dianne DeLeeuw", 0),
    ("Tanja Bakić", "American Force (tag team)", 0),
    ("James Griffin (Irish politician)", "Digital audio mixing", 0),
    ("EU Directive on Agency Workers", "Westshore, New Zealand", 7),
    ("Foreign Trade Bank", "Mercedes-Benz Championship (European Tour)", 7),
    ("Solanum interandinum", "James Orengo", 5),
    ("Green Airport", "Big Time Rush: The Movie", 0),
    ("Tarom, Hormozgan", "Cockersdale (band)", 7),
    ("Catene (album)", "Burma at the 1996 Summer Olympics", 0),
    ("Al-Hamraa", "Verici", 0),
    ("Erős Pista", "Technoself", 6),
    ("Mohammed Dajani Daoudi", "Storegga Slide", 5),
    ("Efraín Loyola", "Sublegatus modestus", 7),
    ("Stereotypic behavior", "Ceramica Flaminia - Bossini Docce", 0),
    ("Holly Blake", "Bryan Zoubek", 0),
    ("Edsvalla", "Grant waters", 0),
    ("Kurram (disambiguation)", "Desert Storm Journal", 7),
    ("Simeon the Righteous", "Pence Springs", 9),
    ("Spilarctia nobilis", "ソニックアドバンス3", 0),
    ("Samuel John Gurney Hoare, 1st Viscount Templewood of Chelsea", "New Zealand sand diver", 7),
    ("Dhanwar language (Nepal)", "Maguricea", 0),
    ("List of Kurdish people", "Lasasaurus", 7),
    ("1975 in the environment", "History of mauritius", 0),
    ("Amarcord Ensemble", "Sebastião (given name)", 7),
    ("Worldwide Universities Network", "LP gas", 5),
    ("Calgary flames draft picks", "Glossary of systems theory", 7),
    ("USP16", "China State Construction International Holdings Limited", 8),
    ("Fuck You! (song)", "Variable message sign", 6),
    ("Lake Zurich right bank railway line", "Cyber-Ark", 7),
    ("Pteropurpura deroyana", "Visa requirements for Dominican Republic citizens", 6),
    ("Italy women's national floorball team", "Proto–Pama-Nyungan language", 0),
    ("Manx Telecom", "2888 BC", 0),
    ("Virginia State Route 334 (pre-1928)", "Swedish general election, 1924", 7),
    ("Sasaks", "Kamula language", 6),
    ("Bach family", "Ali Kuşçu", 5),
    ("Niphargus timavi", "Icon Health & Fitness Inc.", 0),
    ("Journey to the West in popular culture", "Matsuyama-jo", 0),
    ("Viscount Hughenden", "Dalhousie Faculty of Computer Science", 8),
    ("Hansgal", "Earl of Forth", 6),
    ("ORP Grom (disambiguation)", "Drug weapon", 0),
    ("Euler Line", "Encausse-les-Thermes", 7),
    ("John Jacob of Montferrat", "Vice Project Doom", 0),
    ("RAFI", "Floyd Lawson The Barber", 0),
]


def check(graph: Graph, pairs: list[tuple[str, str, int]] = PAIRS) -> DataFrame:
    """(query_id, start, end, status, expected, found, ok) for every pair; a missing page has no route."""
    spark = graph.nodes.sparkSession
    asked = spark.createDataFrame([(i, a, b, n) for i, (a, b, n) in enumerate(pairs)], "query_id int, start string, end string, expected int")
    found = route_batch(graph, asked.drop("expected")).select("query_id", "status", F.size("route").alias("found"))
    return asked.join(found, "query_id").select("query_id", "start", "end", "status", "expected", "found", (F.col("expected") == F.col("found")).alias("ok"))
