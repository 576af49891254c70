"""Run the command line."""

import sys

from logspar.cli import main

sys.exit(main(sys.argv[1:]))
