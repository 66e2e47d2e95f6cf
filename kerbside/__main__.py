from kerbside.plans.jobs import main

main()
