"""Launcher for spark-submit, which takes a script rather than a module:

    spark-submit --master yarn --py-files marquee.zip run_marquee.py build-movies --titles ... --out ...

(``marquee.zip`` is the ``marquee/`` folder zipped; executors do not need it, the
driver does in cluster mode.)
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marquee.__main__ import cli  # noqa: E402

if __name__ == "__main__":
    cli()
