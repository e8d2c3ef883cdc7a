import sys

from millrace.plans.cli import main

sys.exit(main())
