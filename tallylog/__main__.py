from tallylog.cli import main

raise SystemExit(main())
