"""Hand-written edge rows (titles and ratings in the raw TSV layout) and the
results expected for them, worked out by hand."""

import bz2
import gzip
import os

HEADER_TITLES = "tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres"
HEADER_RATINGS = "tconst\taverageRating\tnumVotes"

N = "\\N"

TITLE_LINES = [
    f"tt01\tmovie\tA\tA\t0\t2000\t{N}\t90\tDrama,Comedy",
    f"tt02\tmovie\t\"Q\t\"Q\t0\t2000\t{N}\t90\tDrama",
    f"tt03\tmovie\tR\tR\t0\t2001\t{N}\t{N}\tDrama",
    f"tt04\tmovie\tN\tN\t0\t{N}\t{N}\t{N}\t{N}",
    f"tt05\tmovie\tE\tE\t0\t{N}\t1999\t{N}\tShort",
    "tt06\ttvSeries\tS\tS\t0\t2001\t2003\t30\tSport",
    f"tt07\tmovie\tU\tU\t0\t2000\t{N}\t{N}\tSport",
    f"tt08\tmovie\tT1\tT1\t0\t2000\t{N}\t{N}\tSport",
    f"tt09\tmovie\tT2\tT2\t0\t2000\t{N}\t{N}\tSport",
    f"tt10\tmovie\tback\\slash\tback\\slash\t0\t2002\t{N}\t{N}\t",
    f"tt11\tmovie\tshort\tshort\t0\t2002\t{N}",
    f"tt12\tmovie\t\t\t0\t2003\t{N}\t{N}\tDrama",
]

RATING_LINES = [
    "tt01\t9.0\t10",
    "tt02\t9.0\t12",
    "tt03\t8.0\t5",
    "tt05\t7.0\t5",
    "tt08\t6.0\t7",
    "tt09\t6.0\t7",
    "tt99\t1.0\t1",
]


def write_inputs(base: str, codec: str | None = None) -> tuple[str, str]:
    """Write the two files (optionally .gz / .bz2) and return their paths."""
    os.makedirs(base, exist_ok=True)
    out = []
    for name, header, lines in (("titles", HEADER_TITLES, TITLE_LINES), ("ratings", HEADER_RATINGS, RATING_LINES)):
        data = ("\n".join([header, *lines]) + "\n").encode("utf-8")
        if codec == "gzip":
            path = os.path.join(base, f"{name}.tsv.gz")
            with gzip.open(path, "wb") as f:
                f.write(data)
        elif codec == "bzip2":
            path = os.path.join(base, f"{name}.tsv.bz2")
            with bz2.open(path, "wb") as f:
                f.write(data)
        else:
            path = os.path.join(base, f"{name}.tsv")
            with open(path, "wb") as f:
                f.write(data)
        out.append(path)
    return out[0], out[1]


EXPECTED_MOVIES_PER_YEAR = {1999: 1, 2000: 5, 2001: 1, 2002: 2, 2003: 1, None: 1}
EXPECTED_MOST_VOTED = {
    2000: ("tt02", '"Q', 12),
    2001: ("tt03", "R", 5),
    2002: ("tt10", "back\\slash", -1),
    2003: ("tt12", "", -1),
    None: ("tt05", "E", 5),
}
EXPECTED_TOP10 = {2000: ["tt02", "tt01", "tt08", "tt09"], 2001: ["tt03"], None: ["tt05"]}
EXPECTED_TOP2_GENRE = {"Drama": ["tt02", "tt01"], "Short": ["tt05"], "Sport": ["tt08", "tt09"]}
EXPECTED_RECS = {
    "tt01": "tt02",
    "tt02": "tt01",
    "tt03": "tt02",
    "tt07": "tt08",
    "tt08": "tt09",
    "tt09": "tt08",
    "tt12": "tt02",
}
