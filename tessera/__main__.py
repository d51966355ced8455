"""python -m tessera COMMAND ...: evaluations and reports from folders of files, through the session's Spark."""

import sys

from tessera.plans.cli import main

sys.exit(main(sys.argv[1:]))
