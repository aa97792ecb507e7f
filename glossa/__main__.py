from glossa.cli import main

raise SystemExit(main())
