from gatelight.commands import main

raise SystemExit(main())
