from marlstone.cli import main

raise SystemExit(main())
