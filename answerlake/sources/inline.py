"""Small fixed dimension tables.

They are bounded by construction (tens of rows), so joins against them are
broadcast.  The values are fixed values of the original application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: the closed question taxonomy, in its original order, plus
# the catch-all label.
TAXONOMY = [
    "Economy",
    "Healthcare",
    "Education",
    "Immigration",
    "Environment",
    "National Security",
    "Criminal Justice",
    "Social Justice and Civil Rights",
    "Tax Policy",
    "Gun Control",
    "Infrastructure",
    "Public Safety",
    "Foreign Policy",
    "Housing",
    "Social Welfare Programs",
    "Drug Policy",
    "Veterans Affairs",
    "Technology and Privacy",
    "Election Integrity",
    "Reproductive Rights",
    "Gender",
    "Religious Freedom",
]
OTHER = "Other"
TEST_CATEGORY = "Test"

# --- Fixed values: the two candidates (vote values) and their display names.
CANDIDATES = ["trump", "biden"]
DISPLAY_NAMES = {"trump": "Donald Trump", "biden": "Joe Biden"}
TIE = "Tie"
NO_REFERENCE = "No reference provided"

# --- Fixed values: the badge catalogue (id, name, description).
BADGES = [
    (1, "First Question", "First question asked, folks."),
    (2, "First Vote", "C'mon, man you voted for the first time."),
    (3, "Daily Voter", "Voted every single day for a whole week, believe me."),
    (4, "Top Debater", "Here's the deal, you just asked 10 questions."),
    (5, "Engaged Voter", "Voted 10 times, tremendous!"),
    (6, "Curious Mind", "Viewed 10 responses."),
    (7, "Debate Enthusiast", "Folks, let me tell you, you completed 5 debates."),
    (8, "Weekly Voter", "Voted every day for a month."),
    (9, "Question Master", "Asked 20 questions."),
    (10, "Vote Champion", "Voted 20 times."),
    (11, "Insightful", "Let me be clear, you viewed 20 responses."),
    (12, "Debate Pro", "Been in 10 debates, tremendous debates, believe me."),
    (13, "Monthly Voter", "Voted every day for 3 months."),
    (14, "Question Guru", "I'm not joking, you asked 50 questions."),
    (15, "Vote Legend", "Voted 50 times."),
    (16, "Knowledge Seeker", "Viewed 50 responses."),
    (17, "Debate Master", "I think I am actually humble. I think I'm much more humble than you would understand."),
    (18, "Consistent Voter", "Voted in every debate."),
    (19, "Inquisitive", "I know words, I have the best words."),
    (20, "Interactive", "Clicked on 10 debate topics."),
]

# --- Fixed values: the milestone rules the application actually awards
# (event kind, n-th event, badge id).
BADGE_RULES = [
    ("question", 1, 1), ("question", 10, 4), ("question", 20, 9), ("question", 50, 14),
    ("vote", 1, 2), ("vote", 10, 5), ("vote", 20, 10), ("vote", 50, 15),
    ("correct", 1, 16), ("correct", 10, 17), ("correct", 20, 18),
    ("topic_click", 1, 20),
]

# Declared in the catalogue without awarding code: daily-vote streaks of 7, 30
# and 90 days (badges 3, 8, 13).  Offered as "declared only".
STREAK_RULES = [(7, 3), (30, 8), (90, 13)]

# --- Fixed values: per-candidate answer templates (the question is appended).
CANDIDATE_TEMPLATES = {
    "trump": (
        "Respond as if you were Donald Trump expressing his views, you are trying to win a debate against "
        "Joe Biden you can only use verified data to answer, never mention previous presidents or "
        "administrations, this needs to be verified by statements he's made. Do not refer to yourself by "
        "name or title (e.g., President, Donald Trump). Do not refer to Joe Biden by name. If the prompt is "
        "irrelevant to Trump or politics, refuse to answer it. Provide a concise response limited to two "
        "sentences. Avoid using any Trump mannerisms or language that could easily identify him, remember "
        "you are still trying to win the debate and need to respond accordingly: "),
    "biden": (
        "Respond as if you were Joe Biden expressing his views, you are trying to win a debate against "
        "Donald Trump you can only use verified data to answer, never mention previous presidents or "
        "administrations, this needs to be verified by statements he's made. Do not refer to yourself by "
        "name or title (e.g., President, Joe Biden). Do not refer to Donald Trump by name. If the prompt is "
        "irrelevant to Biden or politics, refuse to answer it. Provide a concise response limited to two "
        "sentences. Avoid using any Biden mannerisms or language that could easily identify him, remember "
        "you are still trying to win the debate and need to respond accordingly: "),
}

# --- Fixed values: system instructions of the answering variants.
SYSTEM_ENDPOINT = (
    "You are a neutral and monotone responder. Do not ever mention the speaker. Answer questions based "
    "only on the provided context. Avoid any mention of other parties, candidates, or specific "
    "individuals. Stick to the facts, avoid any mannerisms or opinions, and keep the answer short, clear, "
    "and concise. Respond directly as if you are the speaker.")
SYSTEM_CHAT = (
    "Answer the question as if you are the speaker. Answer with facts based only on the provided context, "
    "and if the context does not have enough relevant information, say that you do not have enough "
    "information to answer the question. Avoid any mention of specific political parties or candidates. "
    "Keep the answer short, clear, and concise.")

SYSTEM_CATEGORISE = (
    "You are a political scientist at a national newspaper. \n"
    "Categorize the next statements to their most relevant political key issue.\n"
    "If the statement is not similar to any key issue, then categorize it as Other.\n"
    "The key issues are:\n" + ",\n".join(TAXONOMY))

# --- Fixed values: the sentinel inputs that end the chat loop.
SENTINELS = ["exit", "quit"]

# Roles of the test ``events`` table in the engagement model (ours):
# a response view is an asked question, a purchase is a vote, a click is a
# topic click, a signup is a trivia answer; errors are failed asks.
EVENT_KINDS = {"view": "question", "purchase": "vote", "click": "topic_click", "signup": "quiz_answer"}


def taxonomy(spark: SparkSession, with_other: bool = True) -> DataFrame:
    rows = [(i, label) for i, label in enumerate(TAXONOMY)]
    if with_other:
        rows.append((len(TAXONOMY), OTHER))
    return spark.createDataFrame(rows, "label_id int, label string")


def badges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BADGES, "badge_id int, name string, description string")


def badge_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BADGE_RULES, "kind string, n int, badge_id int")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CANDIDATE_TEMPLATES.items()), "candidate string, template string")


def lit_map(mapping: dict) -> F.Column:
    """A literal MAP column (for tiny fixed lookups inside expressions)."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
