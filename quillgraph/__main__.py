import sys

from quillgraph.service import main

main(sys.argv[1:])
