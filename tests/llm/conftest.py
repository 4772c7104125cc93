import pytest

PROSE = (
    "The quick brown fox met a lazy dog near the old river and both of them decided to walk home before the rain began to fall. "
    "Nobody in the village had seen such a pair, so people left their houses, asked a few questions and laughed about it for weeks."
)


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, blanks, repeats, a long text, personal data, and columns named like outputs."""
    rows = [
        (1, PROSE, "en", "a", 9), (1, PROSE, "en", "a", 9), (2, None, "en", "a", 9), (3, "", None, "a", 9), (4, " \n\t ", "de", None, 9), (5, (PROSE + "\n") * 300, "en", "b", 9),
        (6, 'mail jo.doe@mail.example.com from 10.20.30.40 card 4111 1111 1111 1111 call +1 (017) 555-7713 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "en", "b", 9),
        (7, "Der schnelle braune Fuchs traf einen faulen Hund am alten Fluss und beide gingen nach Hause, bevor der Regen begann.", "de", "b", 9), (8, PROSE.replace("weeks", "years"), "en", "b", 9), (9, "12 34 !!", "de", "b", 9),
        (10, "x", "en", "b", 9), (11, "Der alte Hund und die faule Katze gingen am Fluss nach Hause und der Regen fiel auf das Dorf.", None, "b", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_tokens int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
