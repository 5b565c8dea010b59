"""The command line."""

import sys

from .sources.database import main

sys.exit(main())
