"""A small labelled URL table, written by hand: pages one would block (gambling, adult, drug and
loan spam, trackers, piracy, phishing) and ordinary ones. All hosts are invented."""

BLOCK = """
http://casino-royal-spins.example/en/bonus
https://www.casinowinner.example/slots/free-spins
http://bestcasino24.example/register
https://m.online-casino.example/de/bonus-code
http://poker-bets.example/join
https://pokerstake.example/tournament/win
http://bet365win.example/odds
https://sports-bets.example/en/live-odds
http://free-bets.example/sign-up
https://www.betting-tips.example/sure-win
http://slots-jackpot.example/play
https://jackpot-slot.example/spin
http://lotto-win.example/claim-prize
https://win-prize.example/claim?id=7
http://free-prize-iphone.example/winner
http://adult-cams.example/live
https://www.adult-x.example/videos
http://xxx-tube.example/watch/88
https://m.xxxmovies.example/category/hot
http://porn-hd.example/video/12
https://pornvideos.example/free
http://sexcams.example/girls/live
https://sex-dating.example/meet-tonight
http://hot-singles-dating.example/near-you
https://adultdating.example/join-free
http://escort-girls.example/city
http://cheap-pills.example/order
https://buy-viagra.example/no-prescription
http://viagra-cheap.example/pharmacy
https://pharmacy-pills.example/discount
http://cialis-discount.example/buy-now
https://weight-loss-pills.example/miracle
http://miracle-diet.example/lose-weight-fast
https://cheap-meds.example/order-now
http://steroids-shop.example/buy
https://payday-loan.example/apply-now
http://fast-cash-loans.example/apply
https://instant-loans.example/no-credit-check
http://cheap-credit.example/loan-offer
http://make-money-fast.example/secret
https://earn-cash-online.example/work-from-home
http://crypto-doubler.example/send-btc
https://free-bitcoin.example/claim
http://bitcoin-profit.example/trading-robot
https://forex-robot.example/guaranteed-profit
http://ads-track.example/click?id=9
https://ads.clicktracker.example/pixel.gif
http://adserver.example/banner/728x90
https://popads.example/popunder.js
http://click-ads.example/redirect?to=x
https://track.adclick.example/conversion
http://banner-ads.example/serve
https://pop-under.example/click
http://spam-offers.example/unsubscribe
https://cheap-offers.example/deal-now
http://free-giftcards.example/generator
https://giftcard-generator.example/free
http://free-download-crack.example/keygen
https://cracks-keygen.example/serial
http://warez-board.example/full-download
https://torrent-movies.example/download
http://free-movies-torrent.example/watch-online
https://mp3-free-download.example/album
http://serial-keys.example/windows-crack
https://softwarecracked.example/activator
http://secure-login-verify.example/account/update
https://account-verify.example/login/confirm
http://paypa1-login.example/verify
https://bank-login-secure.example/confirm-password
http://update-your-account.example/verify-card
https://password-reset-alert.example/login
http://virus-alert-call.example/support
https://pc-cleaner-free.example/download
http://free-antivirus-scan.example/alert
https://replica-watches.example/cheap
http://cheap-handbags.example/replica
https://replica-bags.example/outlet
http://essay-writers-cheap.example/order
https://buy-followers.example/cheap
http://cheap-seo-links.example/buy-backlinks
"""

ALLOW = """
https://www.city-library.example/catalogue/new
http://library.example/opening-hours
https://museum-of-nature.example/en/exhibitions
http://www.art-museum.example/visit
https://university.example/departments/physics
http://physics.university.example/lectures/optics
https://www.school-garden.example/news/spring
http://primary-school.example/parents
https://news-daily.example/politics/2021/04
http://www.morning-herald.example/world/article-118
https://weather-service.example/forecast/coast
http://mountain-weather.example/avalanche-report
https://recipes.example/soups/lentil
http://www.kitchen-notes.example/bread/sourdough
https://garden-blog.example/roses/pruning
http://birdwatching.example/species/heron
https://www.hiking-trails.example/alps/day-tours
http://cycling-club.example/routes
https://history-review.example/medieval/trade
http://www.archaeology.example/field-reports/2019
https://open-data.example/datasets/transport
http://statistics-office.example/population/census
https://www.parliament.example/debates/session-12
http://ministry-of-health.example/guidelines
https://hospital.example/departments/cardiology
http://www.public-health.example/vaccination
https://encyclopedia.example/wiki/Photosynthesis
http://dictionary.example/words/etymology
https://www.language-course.example/spanish/lesson-4
http://grammar-notes.example/verbs
https://mathematics.example/algebra/groups
http://www.number-theory.example/primes
https://astronomy-club.example/observing/saturn
http://planetarium.example/programme
https://www.software-docs.example/reference/install
http://docs.database.example/tutorial/joins
https://programming-blog.example/posts/parsers
http://www.compiler-notes.example/register-allocation
https://railway-timetable.example/stations
http://www.bus-service.example/lines/42
https://airport.example/arrivals
http://harbour-authority.example/shipping
https://www.theatre.example/season/autumn
http://orchestra.example/concerts
https://film-festival.example/programme/2022
http://www.poetry-archive.example/poets
https://bookshop.example/authors/novels
http://publishing-house.example/new-titles
https://www.football-club.example/fixtures
http://chess-federation.example/ratings
https://swimming-pool.example/lessons
http://www.tennis-club.example/courts
https://farmers-market.example/stalls
http://organic-farm.example/vegetables
https://www.carpentry.example/joints
http://pottery-studio.example/courses
https://knitting-patterns.example/scarves
http://www.sewing-notes.example/sleeves
https://insurance-advice.example/household
http://consumer-council.example/tests/washing-machines
https://www.energy-agency.example/solar
http://water-works.example/quality-report
https://recycling.example/collection-days
http://www.forest-service.example/fire-danger
https://geology-survey.example/maps
http://ocean-institute.example/tides
https://www.climate-research.example/reports/ice
http://chemistry-lab.example/safety
https://biology-notes.example/cells
http://www.veterinary-clinic.example/cats
https://dog-training.example/puppies
http://botanical-garden.example/orchids
https://www.town-council.example/minutes
http://village-history.example/church
https://court-reports.example/decisions/2020
http://www.legal-advice.example/tenancy
https://labour-office.example/vacancies
http://pension-fund.example/annual-report
https://www.savings-bank.example/branches
http://economics-review.example/inflation
https://charity.example/volunteering
http://www.red-lantern-theatre.example/tickets
https://photo-journal.example/landscapes
http://camera-reviews.example/lenses
https://www.travel-notes.example/portugal/lisbon
http://island-ferries.example/timetable
https://youth-hostel.example/rooms
http://www.camping-guide.example/lakes
https://coffee-roasters.example/beans
http://tea-house.example/menu
"""


def rows() -> list[tuple[int, str, str]]:
    """(id, url, verdict) of every labelled URL."""
    named = [(u, v) for text, v in ((BLOCK, "block"), (ALLOW, "allow")) for u in text.split()]
    return [(i, u, v) for i, (u, v) in enumerate(named)]
